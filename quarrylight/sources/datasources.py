"""Bundles and source trees as Spark data sources.

``quarrylight_bundle`` reads and writes bundles: NDJSON sequences and a manifest
of their files with bytes, counts and digests. A read is planned in byte ranges;
what the manifest says is verified by tasks of the same job, so a read that ends
well is of the files that were written. A write stages files that tasks commit;
the driver writes the manifest last and publishes all by one rename, so a killed
write leaves nothing that can be read.

``quarrylight_tree`` walks a source tree without following links. Directories near
the root are planned by the driver, what is below them is walked by tasks. It lists
hidden files, and reports links and special files as security failures.

Both work on mounted file systems, the only ones with links; for other stores
there are ``scan_directory`` and Spark's own readers.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import shutil
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarrylight.sources.bundles import SCHEMAS
from quarrylight.sources.scan import CONTROL_SHARE, SENSITIVE, glob_regex

# The layouts' names.
VERSIONS = ("v1alpha1", "v1alpha2")
COUNTS = {
    "artifacts": "artifact_count", "contributions": "contribution_count", "evidence": "evidence_unit_count",
    "frontend_manifests": "frontend_manifest_count", "facts": "canonical_fact_count", "extensions": "extension_count",
}
LIMITS = {
    "artifacts": "max_artifacts", "contributions": "max_contributions", "evidence": "max_evidence_units",
    "frontend_manifests": "max_frontend_manifests", "facts": "max_canonical_facts", "extensions": "max_extensions",
}
REQUIRED = {"v1alpha1": ("artifacts", "contributions"), "v1alpha2": ("artifacts", "contributions", "frontend_manifests", "facts", "extensions")}
BUNDLE_ONLY = ("organization", "analysis", "factual_digest", "files", "counts", "limits", "evidence")
MANIFEST_BYTES = 1 << 20
SPLIT_BYTES = 64 << 20


def local(path: str) -> str:
    """The mounted path of a ``file:`` URI or a plain path."""
    plain = re.sub(r"^file:(//)?(?=/)", "", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", plain):
        raise ValueError(f"{path} isn't on a mounted file system")
    return plain


# --- bundles -----------------------------------------------------------------


@dataclass(frozen=True)
class Sequence:
    """A file of a sequence and what the manifest says of it; None: not said."""

    name: str
    file: str
    count: int | None
    bytes: int | None = None
    digest: str | None = None


def bundle_files(path: str, max_bytes: int | None = None) -> list[Sequence]:
    """The files that a bundle's manifest lists; ValueError if it breaks a rule.

    A manifest without a version is of the legacy layout: two sequences, of which
    only the counts are known. Limits in the manifest and ``max_bytes`` both hold.
    """
    with open(f"{path}/manifest.json", "rb") as f:
        raw = f.read(MANIFEST_BYTES + 1)
    if len(raw) > MANIFEST_BYTES:
        raise ValueError("the manifest is too large")
    manifest = json.loads(raw)
    version = manifest.get("version")
    if version is None:
        extra = [k for k in BUNDLE_ONLY if k in manifest]
        if extra:
            raise ValueError(f"{extra[0]} needs a bundle version")
        return [Sequence(n, f"{n}.ndjson", manifest[COUNTS[n]]) for n in ("artifacts", "contributions")]
    if version not in VERSIONS:
        raise ValueError(f"unsupported bundle version {version!r}")
    limits, counts = manifest.get("limits") or {}, manifest.get("counts") or {}
    files = []
    for f in manifest.get("files") or []:
        name = re.sub(r"\.ndjson(/[^/]+)?$", "", f["name"])
        if not re.fullmatch(r"[a-z_]+\.ndjson(/[A-Za-z0-9-]+\.ndjson)?", f["name"]):
            raise ValueError(f"unsafe file name {f['name']!r}")
        files.append(Sequence(name, f["name"], f["count"], f["bytes"], f["digest"]))
    if len({f.file for f in files}) != len(files):
        raise ValueError("a file is listed twice")
    state = (manifest.get("evidence") or {}).get("state", "available" if any(f.name == "evidence" for f in files) else "limited")
    needed = [*REQUIRED[version], *(["evidence"] if state == "available" else [])]
    if missing := [n for n in needed if n not in {f.name for f in files}]:
        raise ValueError(f"sequence {missing[0]} is missing")
    for name, key in COUNTS.items():
        own = sum(f.count for f in files if f.name == name)
        if key in counts and own != counts[key]:
            raise ValueError(f"{name}: {own} rows are listed, {counts[key]} counted")
        if limits.get(LIMITS[name]) and own > limits[LIMITS[name]]:
            raise ValueError(f"{name}: {own} rows are beyond the limit")
    allowed = min([x for x in (limits.get("max_bundle_bytes"), max_bytes) if x], default=None)
    if allowed is not None and sum(f.bytes for f in files) > allowed:
        raise ValueError("the bundle is larger than its limit")
    return files


@dataclass
class _Range(InputPartition):
    """Bytes of a file; ``verify``: the whole file is held against the manifest."""

    sequence: Sequence
    start: int
    stop: int
    rows: bool
    verify: bool

    def __init__(self, sequence: Sequence, start: int, stop: int, rows: bool, verify: bool):
        self.sequence, self.start, self.stop, self.rows, self.verify = sequence, start, stop, rows, verify


class BundleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.only = options.get("sequence")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.max_bytes = int(options["maxBytes"]) if "maxBytes" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for s in bundle_files(self.path, self.max_bytes):
            if self.only in (None, s.name):
                size = os.path.getsize(f"{self.path}/{s.file}")
                if s.bytes is not None and size != s.bytes:
                    raise ValueError(f"{s.file} has {size} bytes, not {s.bytes}")
                starts = range(0, max(size, 1), self.split)
                out += [_Range(s, a, min(size, a + self.split), True, len(starts) == 1) for a in starts]
                out += [_Range(s, 0, size, False, True)] if len(starts) > 1 else []
        return out or [_Range(Sequence("", "", None), 0, 0, False, False)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        s = partition.sequence
        if not s.file:
            return
        digest, count, lines, offsets = hashlib.sha256(), 0, [], []
        names = ["sequence", "file", "offset", "value"]

        def batch() -> pa.RecordBatch:
            cols = [pa.array([s.name] * len(lines)), pa.array([s.file] * len(lines)), pa.array(offsets, pa.int64()), pa.array([x.decode() for x in lines], pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        with open(f"{self.path}/{s.file}", "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()  # the line before reaches up to here at least
            at = f.tell()
            while at < partition.stop and (line := f.readline()):
                if partition.verify:
                    digest.update(line)
                if not line.strip():
                    raise ValueError(f"{s.file}: a blank line at byte {at}")
                count += 1
                if partition.rows:
                    lines.append(line.rstrip(b"\r\n"))
                    offsets.append(at)
                    if len(lines) == 4096:
                        yield batch()
                        lines, offsets = [], []
                at += len(line)
        if partition.verify and s.count is not None and count != s.count:
            raise ValueError(f"{s.file} has {count} rows, not {s.count}")
        if partition.verify and s.digest is not None and digest.hexdigest() != s.digest:
            raise ValueError(f"{s.file} differs from its digest")
        if lines:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    files: list[Sequence]


class BundleWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = local(options["path"]).rstrip("/"), overwrite
        self.envelope = json.loads(options.get("manifest", "{}"))
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        parent, name = os.path.split(self.path)
        self.staging = os.path.join(parent, f".{name}.{uuid.uuid4().hex}")
        os.makedirs(self.staging)

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.ndjson"
        open_files: dict = {}
        for row in iterator:
            name = row[0]
            if name not in open_files:
                if not re.fullmatch(r"[a-z_]+", name or ""):
                    raise ValueError(f"unsafe sequence name {name!r}")
                with contextlib.suppress(FileExistsError):  # of another task; where the write was aborted, the folder above is gone
                    os.mkdir(f"{self.staging}/{name}.ndjson")
                open_files[name] = [open(f"{self.staging}/{name}.ndjson/{part}", "xb"), hashlib.sha256(), 0, 0]  # noqa: SIM115
            own, line = open_files[name], row[1].encode() + b"\n"
            own[0].write(line)
            own[1].update(line)
            own[2], own[3] = own[2] + 1, own[3] + len(line)
        for own in open_files.values():
            own[0].flush()
            os.fsync(own[0].fileno())
            own[0].close()
        return _Written([Sequence(n, f"{n}.ndjson/{part}", o[2], o[3], o[1].hexdigest()) for n, o in open_files.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f.file)
        for top, _, names in os.walk(self.staging):  # of attempts that weren't committed
            for name in names:
                if os.path.relpath(f"{top}/{name}", self.staging) not in {f.file for f in files}:
                    os.remove(f"{top}/{name}")
        version = self.envelope.get("version", "v1alpha2")
        for name in REQUIRED[version]:
            if name not in {f.name for f in files}:
                os.makedirs(f"{self.staging}/{name}.ndjson", exist_ok=True)
                open(f"{self.staging}/{name}.ndjson/empty.ndjson", "wb").close()
                files.append(Sequence(name, f"{name}.ndjson/empty.ndjson", 0, 0, hashlib.sha256().hexdigest()))
        for name in {f.name for f in files}:
            own = [f for f in files if f.name == name]
            if len(own) == 1:  # a sequence of one part is a plain file
                os.rename(f"{self.staging}/{own[0].file}", f"{self.staging}/{name}.tmp")
                shutil.rmtree(f"{self.staging}/{name}.ndjson")
                os.rename(f"{self.staging}/{name}.tmp", f"{self.staging}/{name}.ndjson")
                files[files.index(own[0])] = Sequence(name, f"{name}.ndjson", own[0].count, own[0].bytes, own[0].digest)
        counts = {key: sum(f.count for f in files if f.name == name) for name, key in COUNTS.items()}
        manifest = {
            **self.envelope, "version": version, "artifact_count": counts["artifact_count"], "contribution_count": counts["contribution_count"], "counts": counts,
            "files": [{"name": f.file, "bytes": f.bytes, "count": f.count, "digest": f.digest} for f in sorted(files, key=lambda f: f.file)],
            "evidence": {"state": "available" if counts["evidence_unit_count"] else "limited"},
        }
        with open(f"{self.staging}/manifest.json", "x") as f:
            json.dump(manifest, f, indent=2)
            f.flush()
            os.fsync(f.fileno())
        self._publish()

    def _publish(self) -> None:
        """One rename where nothing is there; else the old bundle steps aside and
        comes back if the new one can't take its place."""
        before = f"{self.staging}.before"
        replaced = self.overwrite and os.path.exists(self.path)
        if replaced:
            os.rename(self.path, before)
        try:
            os.rename(self.staging, self.path)
        except OSError:
            if replaced:
                os.rename(before, self.path)
            raise
        if replaced:
            shutil.rmtree(before)

    def abort(self, messages: list[_Written | None]) -> None:
        gone = f"{self.staging}.gone"  # tasks that still run can't make files in it any more
        os.rename(self.staging, gone)
        shutil.rmtree(gone, ignore_errors=True)


class BundleSource(DataSource):
    """Lines of a bundle: sequence, file, offset (byte), value (JSON). Written rows
    are (sequence, value); options path, sequence, splitBytes, maxBytes, manifest."""

    @classmethod
    def name(cls) -> str:
        return "quarrylight_bundle"

    def schema(self) -> str:
        return "sequence string, file string, offset long, value string"

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options)

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options, overwrite)


def publish_bundle(tables: dict[str, DataFrame], path: str, envelope: dict | None = None, overwrite: bool = False) -> None:
    """Write tables as the sequences of one bundle, all or nothing. Nulls are left
    out of the rows, as in every bundle; no table at all gives empty sequences."""
    spark = SparkSession.active()
    spark.dataSource.register(BundleSource)
    rows = spark.createDataFrame([], "sequence string, value string")
    for name, df in sorted(tables.items()):
        rows = rows.unionByName(df.select(F.lit(name).alias("sequence"), F.to_json(F.struct(*df.columns)).alias("value")))
    rows.write.format("quarrylight_bundle").option("manifest", json.dumps(envelope or {})).mode("overwrite" if overwrite else "append").save(path)


def open_bundle(spark: SparkSession, path: str, schemas: dict[str, str] = SCHEMAS, **options) -> dict[str, DataFrame]:
    """The verified tables of a bundle of any layout, by sequence; those without a
    schema as JSON text. A row that isn't its schema's fails the read."""
    spark.dataSource.register(BundleSource)
    out = {}
    for name in sorted({s.name for s in bundle_files(local(path), options.get("maxBytes"))}):
        lines = spark.read.format("quarrylight_bundle").options(**options).option("sequence", name).load(path)
        out[name] = lines.select(F.from_json("value", schemas[name], {"mode": "FAILFAST"}).alias("r")).select("r.*") if name in schemas else lines.select("value")
    return out


# --- source trees ------------------------------------------------------------

TREE = "path string, kind string, code string, detail string, size long, sha256 string, classification string, text string, truncated boolean"


@dataclass
class _Folder(InputPartition):
    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(local(options["path"]))
        self.splits = int(options.get("splits", 64))
        self.extract = int(options.get("extractBytes", 1 << 20))
        compiled = lambda key, more=(): [(p, re.compile(glob_regex(p))) for p in (*json.loads(options.get(key, "[]")), *more)]
        self.include, self.exclude = compiled("include"), compiled("exclude")
        self.sensitive = [] if options.get("includeSensitive") == "true" else compiled("sensitive", SENSITIVE)

    def _relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def _folders(self, path: str) -> list[str]:
        """The folders in a folder that are walked."""
        try:
            with os.scandir(path) as entries:
                own = [e.path for e in entries if e.is_dir(follow_symlinks=False)]
        except OSError:
            return []
        return sorted(p for p in own if not any(x.match(self._relative(p)) for _, x in self.exclude))

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no folder")
        shallow, deep = [], [self.root]
        while deep and len(deep) < self.splits and (below := [(d, self._folders(d)) for d in deep]) and any(x for _, x in below):
            shallow += [d for d, _ in below]
            deep = [p for _, x in below for p in x]
        return [*(_Folder(d, False) for d in shallow), *(_Folder(d, True) for d in deep)]

    def _file(self, entry: os.DirEntry, path: str) -> tuple:
        try:
            # what has become a link since isn't followed
            with os.fdopen(os.open(entry.path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
                first = f.read(self.extract + 1)
                digest, size = hashlib.sha256(first), len(first)
                while more := f.read(1 << 20):
                    digest.update(more)
                    size += len(more)
        except OSError:
            return (path, "failure", "read", "the file can't be read", None, None, None, None, None)
        cut = first[: self.extract]
        while len(first) > self.extract and cut and (cut[-1] & 0xC0) == 0x80:  # no part of a character
            cut = cut[:-1]
        if len(first) > self.extract and cut and cut[-1] >= 0xC0:
            cut = cut[:-1]
        try:
            text = cut.decode()
            control = sum(b < 9 or b == 11 or 14 <= b < 32 or b == 127 for b in cut)
            binary = b"\0" in cut or control > CONTROL_SHARE * len(cut)
        except UnicodeDecodeError:
            text, binary = None, True
        return (path, "artifact", None, None, size, digest.hexdigest(), "binary" if binary else "text", None if binary else text, size > self.extract)

    def read(self, partition: _Folder) -> Iterator[tuple]:
        left = [partition.path]
        while left:
            folder = left.pop()
            try:
                with os.scandir(folder) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:
                yield (self._relative(folder), "failure", "read", "the folder can't be read", None, None, None, None, None)
                continue
            for e in entries:
                path = self._relative(e.path)
                none = (None,) * 5
                base = path.rsplit("/", 1)[-1]
                mode = e.stat(follow_symlinks=False).st_mode
                if stat.S_ISLNK(mode):
                    yield (path, "failure", "security", "symbolic link", *none)
                elif stat.S_ISDIR(mode):
                    if pattern := next((p for p, x in self.exclude if x.match(path)), None):
                        yield (path, "exclusion", "excluded", pattern, *none)
                elif not stat.S_ISREG(mode):
                    yield (path, "failure", "security", "special file", *none)
                elif self.include and not any(x.match(path) for _, x in self.include):
                    yield (path, "exclusion", "not_included", None, *none)
                elif pattern := next((p for p, x in self.exclude if x.match(path)), None):
                    yield (path, "exclusion", "excluded", pattern, *none)
                elif pattern := next((p for p, x in self.sensitive if x.match(path.lower()) or x.match(base.lower())), None):
                    yield (path, "exclusion", "sensitive", pattern, *none)
                else:
                    yield self._file(e, path)
            if partition.deep:
                left += self._folders(folder)


class TreeSource(DataSource):
    """A source tree: a row for each file, exclusion and failure. Options path,
    include, exclude, sensitive (JSON lists of globs), includeSensitive,
    extractBytes, splits."""

    @classmethod
    def name(cls) -> str:
        return "quarrylight_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), **options) -> DataFrame:
    """The rows of TREE for a folder; an empty one gives none."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("quarrylight_tree").options(include=json.dumps(include), exclude=json.dumps(exclude), **options).load(root)
