"""A training corpus from ``documents``: quality, language, near duplicates, mixing, piece ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftframe.llm import language_parsing, mixing, pieces, quality_cascade, simhash
from weftframe.llm.common import table, vocabulary, written

# least share that the winning language must have of all; clear prose has nearly all of it
LEAST_LANGUAGE_SCORE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_cascade.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told; the model learns from the labelled rows of ``docs``.

    Rejected are texts without a letter and those that no language clearly wins.
    The label that a document carries plays no part in the decision.
    """
    learned = language_parsing.learn(docs.where(~F.coalesce(language_parsing.held_out(), F.lit(True))))
    return language_parsing.keep_known(docs, learned, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of equal or similar texts.

    Similar: five-word shingles overlapping by 0.8 or more. Rows without a doc_id are
    kept; repeated rows of one doc_id are one document.
    """
    groups = simhash.similar_texts(docs, width=5, similarity=0.8)
    firsts = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    unnamed = docs.where(F.col("doc_id").isNull())
    named = docs.join(firsts, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return named.unionByName(unnamed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that give the domains their token shares; good ones are kept whole."""
    labels = table(spark, sf_dir, "labels")
    rates = mixing.mixing_rates(docs, labels, mixing.label_domain(), mixing.WEIGHTS, anchor="good", repeat=False)
    return mixing.mixed(docs, rates, repeat=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), check=True)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("piece_ids", encode),
]

# The language model, the candidates and the fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
