"""Bundles and source trees as data sources."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import datasources as ds

A = '{"id":"artifact-1","source_id":"source-1","path":"a.txt","type":"text","hash":"h","size":3,"kind":"file"}\n'
C = '{"id":"contribution-1","artifact_id":"artifact-1","analyzer_id":"x","analyzer_version":"1","method":"m","type":"t","value":"{}"}\n'


def golden(path, layout, sequences, **more):
    """A bundle as another program writes it, a file a sequence."""
    path.mkdir(parents=True)
    files = []
    for name, lines in sequences.items():
        raw = "".join(lines).encode()
        (path / f"{name}.ndjson").write_bytes(raw)
        files.append({"name": f"{name}.ndjson", "bytes": len(raw), "count": len(lines), "digest": hashlib.sha256(raw).hexdigest()})
    manifest = {"artifact_count": len(sequences["artifacts"]), "contribution_count": len(sequences["contributions"])}
    if layout:
        manifest |= {"version": layout, "files": files, "counts": {ds.COUNTS[n]: len(x) for n, x in sequences.items()}, "evidence": {"state": "available" if "evidence" in sequences else "limited"}}
    (path / "manifest.json").write_text(json.dumps(manifest | more))
    return str(path)


def test_layouts(spark, tmp_path):
    two = {"artifacts": [A], "contributions": [C, C.replace("contribution-1", "contribution-2")]}
    six = two | {"evidence": ['{"id":"e"}\n'], "frontend_manifests": ['{"a":1}\n'] * 2, "facts": ['{"id":"f1"}\n'], "extensions": []}
    for name, version, sequences in (("legacy", None, two), ("v1", "v1alpha1", two), ("v2", "v1alpha2", six)):
        got = ds.open_bundle(spark, golden(tmp_path / name, version, sequences))
        assert {n: df.count() for n, df in got.items()} == {n: len(x) for n, x in sequences.items()}
        assert got["artifacts"].first()["size"] == 3 and [r["id"] for r in got["contributions"].orderBy("id").collect()] == ["contribution-1", "contribution-2"]


@pytest.mark.parametrize("change, said", [
    ({"version": "v9"}, "unsupported"), ({"version": None, "limits": {}}, "needs a bundle version"), ({"limits": {"max_bundle_bytes": 10}}, "larger"),
    ({"limits": {"max_contributions": 1}}, "beyond"), ({"counts": {"artifact_count": 2}}, "counted"), ({"version": "v1alpha2"}, "missing"),
    ({"files": [{"name": "../x.ndjson", "bytes": 1, "count": 1, "digest": ""}]}, "unsafe"),
])
def test_broken_manifests(spark, tmp_path, change, said):
    path = golden(tmp_path / "b", "v1alpha1", {"artifacts": [A], "contributions": [C, C]}, **change)
    with pytest.raises(ValueError, match=said):
        ds.open_bundle(spark, path)


def test_changed_files_fail_the_read(spark, tmp_path):
    path = golden(tmp_path / "b", "v1alpha1", {"artifacts": [A] * 50, "contributions": [C]})
    for change, said in ((A.replace("artifact-1", "artifact-2") + A * 49, "digest"), (A * 49, "bytes"), (A * 49 + " " * (len(A) - 1) + "\n", "blank|digest"), ("{" + A[1:] * 0 + " " * (50 * len(A) - 2) + "\n", "rows")):
        with open(f"{path}/artifacts.ndjson", "w") as f:
            f.write(change)
        for split in (1 << 20, 100):  # one task, and ranges with a task that verifies
            with pytest.raises(Exception, match=said):
                ds.open_bundle(spark, path, splitBytes=split)["artifacts"].count()


def test_write_then_read(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("a"), "id").alias("id"), F.col("id").alias("size"), F.lit("é\n\"x\"").alias("path"), F.lit(None).cast("string").alias("kind"))
    c = spark.range(7).coalesce(1).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("a1").alias("artifact_id"))
    ds.publish_bundle({"artifacts": a, "contributions": c}, path, {"organization": {"id": "o"}})
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["organization"] == {"id": "o"} and manifest["counts"]["artifact_count"] == 1000 and os.path.isfile(f"{path}/contributions.ndjson") and os.path.isdir(f"{path}/artifacts.ndjson")
    for split in (1 << 20, 333):
        got = ds.open_bundle(spark, path, splitBytes=split)
        assert sorted((r["id"], r["size"], r["path"], r["kind"]) for r in got["artifacts"].collect()) == sorted((r["id"], r["size"], r["path"], r["kind"]) for r in a.collect())
        assert got["contributions"].count() == 7 and got["facts"].count() == 0
    with pytest.raises(Exception, match="FileExists|exists"):
        ds.publish_bundle({"artifacts": a}, path)
    ds.publish_bundle({"artifacts": a.limit(3)}, path, overwrite=True)
    assert ds.open_bundle(spark, path)["artifacts"].count() == 3
    assert [p for p in os.listdir(tmp_path) if p.startswith(".")] == []


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        ds.publish_bundle({"artifacts": bad}, path)
    assert os.listdir(tmp_path) == []
    ds.publish_bundle({"artifacts": spark.range(2).select(F.col("id").cast("string"))}, path)
    with pytest.raises(Exception, match="killed"):
        ds.publish_bundle({"artifacts": bad}, path, overwrite=True)
    assert ds.open_bundle(spark, path)["artifacts"].count() == 2


def test_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for d in ("src/a/b", "build/x", ".hidden", "deep/1/2/3/4"):
        (root / d).mkdir(parents=True)
    for name, raw in {
        "src/a/One.java": b"class One {}", "src/a/b/two.py": "é".encode() * 30, "build/x/out.txt": b"x", ".hidden/.note": b"hidden", "deep/1/2/3/4/end.txt": b"", "src/data.bin": b"\0\1\2", "src/bad.txt": b"\xff\xfe", ".env": b"K=1", "src/my_password.txt": b"p", "note.md": b"# x",
    }.items():
        (root / name).write_bytes(raw)
    (root / "src/link").symlink_to("/etc/hostname")
    (root / "loop").symlink_to(root)
    os.mkfifo(root / "src/pipe")
    want = {
        "src/a/One.java": ("artifact", "text"), "src/a/b/two.py": ("artifact", "text"), ".hidden/.note": ("artifact", "text"), "deep/1/2/3/4/end.txt": ("artifact", "text"), "src/data.bin": ("artifact", "binary"), "src/bad.txt": ("artifact", "binary"),
        "build": ("exclusion", "excluded"), ".env": ("exclusion", "sensitive"), "src/my_password.txt": ("exclusion", "sensitive"), "note.md": ("exclusion", "excluded"),
        "src/link": ("failure", "security"), "loop": ("failure", "security"), "src/pipe": ("failure", "security"),
    }
    for splits in (1, 3, 64):
        rows = ds.scan_tree(spark, str(root), exclude=("build", "*.md"), splits=splits, extractBytes=15).collect()
        assert len(rows) == len(want) and {r["path"]: (r["kind"], r["code"] or r["classification"]) for r in rows} == want
        two = next(r for r in rows if r["path"].endswith("two.py"))
        assert (two["text"], two["size"], two["truncated"], two["sha256"]) == ("é" * 7, 60, True, hashlib.sha256(("é" * 30).encode()).hexdigest())
    only = ds.scan_tree(spark, str(root), include=("**/*.java",)).filter("kind = 'artifact'").collect()
    assert [r["path"] for r in only] == ["src/a/One.java"]
    (tmp_path / "none").mkdir()
    assert ds.scan_tree(spark, str(tmp_path / "none")).count() == 0
