"""The pipeline's stages over columns of any type and name."""

import pytest
from conftest import SMALL

import corpus_pipeline
from quarrylight.llm import common

ODD = "doc_id long, text string, lang string, source string, n_chars long, `a``b` map<string,int>, `a.b` array<int>, `c d` struct<x: map<int,string>>, row int, `tie` string, cut double"


def documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang = 'en' and n_chars between 600 and 3000").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, "en", f"s{i % 3}", len(t), {"k": i, "none": None}, [i], ({1: "x"},), 1, None, 0.5) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", None, None, None, None, None, None, "t", None), (None, texts[1], None, None, None, {}, [], None, None, None, None), (101, None, None, "s0", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows + [rows[2]] * 3, ODD)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_over_odd_columns(spark, name, stage):
    docs = documents(spark)
    got = stage(spark, docs, SMALL)
    if name != "packing":
        assert got.columns == docs.columns and got.schema["a`b"].dataType == docs.schema["a`b"].dataType
    kept = common.materialize(got, "odd").collect()
    assert len(kept) >= 12
    if name == "ngram_join":
        assert [r["doc_id"] for r in kept].count(2) == 1 and 100 not in {r["doc_id"] for r in kept}
    if name == "source_mix":  # rows alike in all columns are taken together
        size = len(docs.filter("doc_id = 2").first()["text"].split())
        assert sum(len(r["text"].split()) for r in kept if r["doc_id"] == 2) <= 2 * 4 * size


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_over_an_empty_table(spark, name, stage):
    assert stage(spark, documents(spark).limit(0), SMALL).count() == 0
