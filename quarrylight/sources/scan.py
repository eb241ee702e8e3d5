"""Directory and archive scans as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files that are never read.
SENSITIVE = (
    ".env", ".env.*", "**/.env", "**/.env.*", "*.pem", "**/*.pem", "*.key", "**/*.key", "*.p12", "**/*.p12", "*.pfx", "**/*.pfx",
    "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "**/id_rsa", "**/id_dsa", "**/id_ecdsa", "**/id_ed25519",
    "**/secrets.*", "**/*secret*", "**/*password*", "**/*credential*", "**/*token*",
)
#: A text may have this share of control bytes.
CONTROL_SHARE = 0.1


@dataclass(frozen=True)
class Limits:
    # The default limits of a scan.
    files: int = 100_000
    file_bytes: int = 256 << 20
    bytes: int = 1 << 30
    members: int = 10_000
    member_bytes: int = 256 << 20
    archive_bytes: int = 1 << 30
    expansion: float = 1_000.0
    extract_bytes: int = 1 << 20


def glob_regex(pattern: str) -> str:
    """A slash glob as a regular expression: ``*`` and ``?`` stay in a component,
    ``**/`` is any number of components, also none."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches_any(path: Column, patterns: tuple[str, ...]) -> Column:
    return path.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(False)


def sensitive(path: Column, patterns: tuple[str, ...] = SENSITIVE) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return matches_any(F.lower(path), patterns) | matches_any(F.lower(base), patterns)


def safe_relative(path: Column) -> Column:
    """Not absolute, no drive, no component that leads up."""
    slashed = F.regexp_replace(path, r"\\", "/")
    return path.isNotNull() & (slashed != "") & ~slashed.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def exclusion(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Why a path is left out, tests in a fixed order; null if it is read."""
    wanted = matches_any(path, include) if include else F.lit(True)
    return F.when(~safe_relative(path), "security").when(~wanted, "not_included").when(matches_any(path, exclude), "excluded").when(sensitive(path), "sensitive")


def is_binary(content: Column) -> Column:
    """A NUL, invalid UTF-8, or more than a tenth of control bytes; empty: text."""
    text = F.decode(content, "ISO-8859-1")
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0B\x0E-\x1F\x7F]", ""))
    return (F.length(text) > 0) & (F.contains(text, F.lit("\0")) | ~F.is_valid_utf8(content.cast("string")) | (control > F.length(text) * CONTROL_SHARE))


def scan_directory(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(artifacts, exclusions) of a tree, which Spark lists and reads.

    artifacts: path, size, sha256, classification, format, text (at most
    ``extract_bytes``), truncated. Excluded files aren't opened: their content
    column is never used. Spark doesn't list names that begin with a dot or an
    underscore, so those are in neither.
    """
    from quarrylight.operators.incremental import limited_walk

    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rows = files.withColumn("path", F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")).withColumn("reason", exclusion(F.col("path"), include, exclude))
    excluded = rows.filter("reason is not null").select("path", "reason")
    kept = limited_walk(rows.filter("reason is null").select(F.lit(base).alias("root"), "path", F.col("length").alias("size")), limits.files, limits.file_bytes, limits.bytes)
    rows = rows.join(kept.select("path", "size"), "path")
    binary = is_binary(F.col("content"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix == "java", "java").when(suffix == "py", "python").when(suffix.isin("xml", "dbs"), "xml").when(suffix.isin("zip", "car", "jar"), "archive").otherwise("text")
    text = F.when(~binary, F.substring(F.col("content").cast("string"), 1, limits.extract_bytes))
    return rows.select(
        "path", "size", F.sha2("content", 256).alias("sha256"), F.when(binary, "binary").otherwise("text").alias("classification"), kind.alias("format"),
        text.alias("text"), (F.col("size") > limits.extract_bytes).alias("truncated"),
    ), excluded


MEMBERS = "path string, member string, size long, compressed long, text string, failure string"


def member_name(name: str) -> str | None:
    """A member's clean relative name; None if it would leave the archive."""
    slashed = name.replace("\\", "/")
    if slashed.startswith("/") or re.match(r"[A-Za-z]:", slashed) or "\0" in slashed:
        return None
    parts = [p for p in slashed.split("/") if p not in ("", ".")]
    return None if ".." in parts or not parts else "/".join(parts)


def archive_members(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Members of zip archives (path, content), or a failure row for an archive
    that is damaged or beyond a limit. Reads declared sizes before any member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
                    if len(infos) > limits.members or total > limits.archive_bytes or total > limits.expansion * max(packed, 1):
                        out.append((path, None, total, packed, None, "limit"))
                        continue
                    for i in sorted(infos, key=lambda i: i.filename):
                        name = member_name(i.filename)
                        if name is None:
                            out.append((path, i.filename, i.file_size, i.compress_size, None, "unsafe_name"))
                        elif i.file_size > limits.member_bytes:
                            out.append((path, name, i.file_size, i.compress_size, None, "limit"))
                        else:
                            raw = z.read(i)
                            try:
                                text = raw.decode()
                            except UnicodeDecodeError:
                                text = None
                            out.append((path, name, i.file_size, i.compress_size, text, None))
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError):
                    out.append((path, None, None, None, None, "damaged"))
            yield pd.DataFrame(out, columns=["path", "member", "size", "compressed", "text", "failure"])

    return archives.select("path", "content").mapInPandas(run, MEMBERS)
