"""The factual store: one marker for all tables, nothing twice, conflicts refused."""

import os

import pytest

from quarrylight.sources import factual

KIND = "scope string, fact_id string, predicate string, object string, qualifiers array<struct<name:string,value:string>>, evidence array<struct<id:string>>, inputs array<string>"


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


A = ("s", "f1", "calls", "x", [("n", "1"), ("m", None)], [("e2",), ("e1",), ("e2",)], None)
B = ("s", "f2", "calls", None, [], [("e1",)], ["f1", "f0"])
C = ("t", "f1", "calls", "y", None, None, None)


def plain(df):
    return sorted((r["scope"], r["fact_id"], r["object"], [tuple(q) for q in r["qualifiers"]], [e["id"] for e in r["evidence"]], r["inputs"]) for r in df.collect())


def test_write_read_and_write_again(spark, tmp_path):
    store = str(tmp_path)
    assert factual.read_facts(spark, store) is None
    assert factual.persist_facts(facts(spark, A, A), store) == 1
    assert factual.persist_facts(facts(spark, A, B, C), store) == 2
    assert factual.persist_facts(facts(spark, A, B, C), store) == 0 and factual.persist_facts(facts(spark), store) == 0
    want = [("s", "f1", "x", [("n", "1"), ("m", None)], ["e2", "e1", "e2"], []), ("s", "f2", None, [], ["e1"], ["f1", "f0"]), ("t", "f1", "y", [], [], [])]
    assert plain(factual.read_facts(spark, store)) == want
    assert plain(factual.read_facts(spark, store, "t")) == want[2:]
    assert len(factual.batches(spark, store)) == 2


@pytest.mark.parametrize("bad", [
    ("s", "f1", "calls", "z", A[4], A[5], None), ("s", "f1", "calls", "x", A[4], [("e1",), ("e2",), ("e2",)], None), ("s", "f1", "calls", "x", A[4], A[5], ["f9"]), ("s", None, "calls", "x", None, None, None),
])
def test_a_conflict_refuses_the_whole_write(spark, tmp_path, bad):
    store = str(tmp_path)
    factual.persist_facts(facts(spark, A), store)
    before = plain(factual.read_facts(spark, store))
    with pytest.raises(ValueError, match="differ|no id"):
        factual.persist_facts(facts(spark, B, bad), store)
    with pytest.raises(ValueError, match="differ|no id"):
        factual.persist_facts(facts(spark, B, (*B[:3], "other", *B[4:]), bad), store)
    assert plain(factual.read_facts(spark, store)) == before


def test_a_batch_without_a_marker_is_not_seen(spark, tmp_path):
    store = str(tmp_path)
    factual.persist_facts(facts(spark, A), store)
    for name in (*factual.SUPPORTS, "facts"):  # what a write leaves that ends before its marker
        os.makedirs(f"{store}/{name}/torn")
        (tmp_path / name / "torn" / "part-0.parquet").write_bytes(b"torn")
    assert len(plain(factual.read_facts(spark, store))) == 1
    assert factual.persist_facts(facts(spark, B), store) == 1


def test_a_write_leaves_no_copies(spark, tmp_path):
    """Neither a write nor a refused one leaves its working copies beside the store."""
    from quarrylight.runtime import shared_dir

    def copies():
        folder = shared_dir(spark) + "/engine"
        return [n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if n.startswith(("facts-", "new-facts-"))]

    before, store = copies(), str(tmp_path)
    factual.persist_facts(facts(spark, A, A, B), store)
    factual.persist_facts(facts(spark, A, B, C), store)
    with pytest.raises(ValueError, match="differ"):
        factual.persist_facts(facts(spark, (*A[:3], "z", *A[4:])), store)
    assert copies() == before and len(plain(factual.read_facts(spark, store))) == 3


def test_fixed_facts_are_not_copied(spark, tmp_path):
    """Facts from files are written without a copy of them, and a write leaves no shuffles."""
    from quarrylight.runtime import durable

    shuffles = lambda: {n for root, _, names in os.walk(spark.conf.get("spark.local.dir", "/tmp")) for n in names if n.startswith("shuffle_")}
    store, names = str(tmp_path), []
    given = durable(facts(spark, A, A, B), "given")
    whole, factual.durable = factual.durable, lambda df, name, *more: names.append(name) or whole(df, name, *more)
    before = shuffles()
    try:
        assert factual.persist_facts(given.filter("fact_id = 'f2'"), store, fixed=True) == 1 and names == []
        assert factual.persist_facts(given, store, fixed=True) == 1 and names == ["new-facts"]
        assert factual.persist_facts(given, store, fixed=True) == 0 and names == ["new-facts"]
    finally:
        factual.durable = whole
    assert shuffles() <= before
    assert plain(factual.read_facts(spark, store)) == [("s", "f1", "x", [("n", "1"), ("m", None)], ["e2", "e1", "e2"], []), ("s", "f2", None, [], ["e1"], ["f1", "f0"])]
