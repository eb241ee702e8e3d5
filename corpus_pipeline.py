"""A training corpus from raw documents: five stages, each a table of its own.

Every stage gets all that the one before it kept, and its decisions take
effect: rejected documents go, one of each group of near copies stays, repeated
paragraphs are cut out of the texts, sources are repeated and cut to their
targets, and the last stage places what is left in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import language_id, mixing, ngram_join, packing, substring_dedup
from quarrylight.llm.common import materialize, release
from quarrylight.llm.queries import table, vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; others, as those without a letter, go.

    Null and empty texts go; an empty table stays empty. Columns may have any names.
    """
    return language_id.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows with a null id and wordless texts stay; rows alike in id and text are one.
    """
    return ngram_join.one_of_each(docs)


def cut_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs and passages that an earlier document has as well.

    All rows stay, those of which nothing is left with an empty text.
    """
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeated, or cut short once a source.

    Null and empty texts go, as they have no word to take; a null source is one.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    Rows that the mix repeats have pieces each; an empty text has its end id.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", join_near_copies),
    ("substring_dedup", cut_repeated_paragraphs),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Hash filters, banding and tokenizers have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
