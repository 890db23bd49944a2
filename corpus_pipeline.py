"""A corpus pipeline: language, repeated lines, near copies, mixing, packing.

Each stage reads all that the one before kept; `run` writes every stage as Parquet to the shared
folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid, line_dedup, mixing, packing, simhash
from gleaner.llm.common import q, written
from gleaner.llm.queries import tokenizer_files

MIN_SCORE = 0.4  # under it no language is likelier than the others together
BUDGET = 0.7  # share of the tokens that mixing keeps
ORACLE_SQL = None  # a fitted model, a component search and a packing are not SQL


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no clear language; a missing lang is filled in."""
    model = langid.train(docs, ~langid.held_out())
    seen = langid.identify(docs, model)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    if not model.classes:  # nothing to learn from: only texts without a letter go
        sure = q("text").rlike(r"\p{L}")
    kept = seen.filter(sure)
    known = F.coalesce("lang", F.when(F.col("lang_pred") != langid.UNKNOWN, F.col("lang_pred")))
    return kept.withColumn("lang", known).select(*(q(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from the texts; every document stays."""
    return _with_length(line_dedup.dedup_lines(docs).select(*(q(c) for c in docs.columns)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies; rows are judged by id and text."""
    return simhash.without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the tempered shares of sources, languages and topics."""
    return mixing.mix(docs, budget=BUDGET).filter("mix_kept").select(*(q(c) for c in docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens; a row a piece."""
    return packing.pack_documents(docs, **tokenizer_files())


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
