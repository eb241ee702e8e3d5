"""Multiset hashes, hard negatives and token alignment against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL, same_rows

from quarrylight.llm import hard_negatives as hn
from quarrylight.llm import multiset_hash as mh
from quarrylight.llm import queries
from quarrylight.llm import token_alignment as ta

ODD = [
    (1, None), (2, ""), (3, "a"), (4, " "), (5, "\n\n"), (6, "one two  three\n\tfour \n five\n"), (7, "x▁y z"), (8, "<|endoftext|> </s> <0x0A> é ß 漢字 \U0001f600 end "),
    (9, "tabs\t\tand no-break lines\x1cmore \x1c it's we'LL 12345"), (9, "the same id"), (9, "the same id"), (None, "no id"), (11, "w" * 5000 + " " + "ab " * 3000), (12, " \n lead"),
]


def frame(spark, rows):
    """With columns that clash with those of the operators."""
    return spark.createDataFrame([(i, t, "c", 1, {"a": 1}) for i, t in rows], "doc_id long, text string, range string, tie int, chunk map<string,int>")


# --- multiset hashes ---------------------------------------------------------


def test_paragraphs_add_up():
    a, b, c = "first line", "", "third line of the text, somewhat longer"
    assert mh.fingerprint("\n".join([a, b, c])) == mh.fingerprint("\n".join([c, a, b])) != mh.fingerprint("\n".join([a, c]))
    assert mh.changed(mh.fingerprint("\n".join([a, b, c])), delete=[b]) == mh.fingerprint("\n".join([c, a]))
    assert mh.changed(mh.fingerprint(a), insert=[b, c, c]) == mh.fingerprint("\n".join([c, a, b, c]))
    assert mh.fingerprint(None) == mh.fingerprint("") != mh.fingerprint("\n")
    assert (mh.decode(mh.changed(mh.fingerprint(c), delete=[c])) == 0).all()


def test_vectors_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdé \n"), n)) for n in (0, 1, 7, 15, 16, 17, 300_000, 40, 600_000)] + ["z" * 700_000, "\n" * 10_000]
    units = [t.encode() for t in texts]
    assert (mh.vectors(units) == np.vstack([mh.vectors([u]) for u in units])).all()


@pytest.mark.parametrize("rows", [ODD, [(5, "alone, with some words")], []])
def test_edited_texts(spark, rows):
    got = mh.edited_fingerprints(frame(spark, rows), range_bytes=100).collect()
    order = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr("*", "xxhash64(text) AS tie").orderBy("doc_id", "tie", "text").collect()
    want = []
    for k, r in enumerate(order):
        after = order[(k + 1) % len(order)]["text"]
        cut = len(r["text"]) - len(r["text"]) // 4
        edited = r["text"][:cut] + after[: len(r["text"]) - cut]
        want.append((r["doc_id"], len(r["text"]), hashlib.sha256(edited.encode()).hexdigest(), mh.fingerprint(r["text"]), mh.fingerprint(edited)))
    assert sorted(((*r[:5],) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert all(r["near_edited"] == 1 for r in got if r["fingerprint"] == r["edited_fingerprint"])
    assert sorted(((*r,) for r in mh.fingerprints(frame(spark, rows)).collect()), key=repr) == sorted((((w[0], w[1], w[3]) for w in want)), key=repr)


def test_edited_texts_are_nearer_than_the_next(spark):
    got = queries.op11_multiset_hash(spark, SMALL).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.98
    assert 0.7 < got.near_edited.median() < 0.85


# --- hard negatives ----------------------------------------------------------


def test_hard_negatives_equal_their_sql(spark, duck):
    same_rows(queries.op12_hard_negatives(spark, SMALL), duck, hn.ORACLE)


def brute(rows, positives, negatives, low, high):
    out = []
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    for i, (a, label, x) in enumerate(good):
        if a % 5:
            continue
        scored = [(-max(-(1 << 63) + 1, min((1 << 63) - 1, sum(p * q for p, q in zip(x, y, strict=True)))), b, m) for j, (b, m, y) in enumerate(good) if j != i and len(y) == len(x)]
        for s, b, _ in sorted(v for v in scored if v[2] == label)[:positives]:
            fits = sorted(v for v in scored if v[2] != label and low * -s <= 100 * -v[0] <= high * -s)[:negatives]
            out += [(a, b, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 1 << 30, 1 << 40])
def test_hard_negatives_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(hn, "BATCH", 7)
    monkeypatch.setattr(hn, "FIRST", 20)
    rng = np.random.default_rng(size)
    rows = [(int(k), int(rng.integers(0, 3)), [int(v) for v in rng.integers(-size // 4, size, 4)]) for k in range(120)]
    rows += [(200, 1, [1, 1, 1, 1])] * 40 + [(205, 1, [size] * 4), (205, 2, [size] * 4), (210, 0, []), (215, 1, []), (220, 2, [0, 0, 0, 0]), (225, 0, [1, 2])]
    rows += [(None, 1, [1, 1, 1, 1]), (230, None, [1, 1, 1, 1]), (235, 1, None), (240, 1, [1, None, 1, 1])]
    df = spark.createDataFrame([(*r, "x", {"a": 1}) for r in rows], "vec_id long, label int, embedding array<long>, norm string, uid map<string,int>")
    got = hn.hard_negatives(df, "vec_id % 5 = 0", positives=4, negatives=2)
    assert sorted((*r,) for r in got.collect()) == brute(rows, 4, 2, 50, 95)
    assert hn.hard_negatives(df.limit(0), "vec_id % 5 = 0").collect() == []


# --- token alignment ---------------------------------------------------------


def paths():
    return queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


def aligned_whole(rows):
    """Every text tokenised whole, its groups by shared offsets, its links by ranges."""
    own, every = ta.Aligner(*paths()), []
    for i, t in rows:
        a, b, groups, links = [], [], [], []
        if t and "▁" not in t:
            a, b = own.a.encode(" " + t, add_special_tokens=False).ids, own.b.encode(t)
            p, q = np.cumsum([0] + [own.a_size[x] for x in a]).tolist(), np.cumsum([0] + [own.b_size[x] for x in b]).tolist()
            assert p[-1] == q[-1] == len((" " + t).encode())
            common = sorted(set(p) & set(q))
            groups = [",".join(map(str, a[p.index(s) : p.index(e)])) + "|" + ",".join(map(str, b[q.index(s) : q.index(e)])) for s, e in zip(common, common[1:], strict=False)]
            first = 0
            for x in range(len(a)):
                while q[first + 1] <= p[x]:
                    first += 1
                y = first
                while y < len(b) and q[y] < p[x + 1]:
                    links.append((a[x], b[y]))
                    y += 1
        every.append((i, a, b, groups, links))
    counts = Counter(x for e in every for x in e[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, x in every
    ]


@pytest.mark.parametrize("rows", [ODD, [(1, None)], []])
def test_alignment_of_odd_texts(spark, monkeypatch, rows):
    monkeypatch.setattr(ta, "CHUNK_BYTES", 300)
    got = [(*r,) for r in ta.align_documents(frame(spark, rows), *paths()).collect()]
    assert sorted(got, key=repr) == sorted(aligned_whole(rows), key=repr)


def test_alignment_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = [(*r,) for r in queries.op13_token_alignment(spark, SMALL).collect()]
    assert sorted(got) == sorted(aligned_whole(rows))


def test_segments_keep_the_text():
    for _, t in ODD:
        if t:
            assert "".join(ta.segments(t)) == " " + t
