"""Sources and sinks for captured traces, cases, pages and caches. Nothing here goes to the network."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE = "tool string, arguments string, output string, is_error boolean, error string, elapsed_ms double"
CACHE = "key string, stored_at double, payload string"
RESPONSES = "request string, status int, content_type string, headers map<string,string>, body string"
INVENTORY = "engine string, enabled boolean, paging boolean, time_range_support boolean"
REDIRECTS = "url string, location string"
MAX_REDIRECTS = 5


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL call trace."""
    return spark.read.schema(TRACE).json(path)


def write_trace(calls: DataFrame, path: str) -> None:
    """Appends calls to a JSONL trace."""
    calls.write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A case manifest: one JSON document over many lines."""
    return spark.read.option("multiLine", True).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).json(path)


def append_cache(rows: DataFrame, path: str) -> None:
    """Adds writes to an append-only cache log; `operators.cache.latest` reads the last of each key."""
    rows.select("key", "stored_at", "payload").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def resolve_redirects(urls: DataFrame, redirects: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with final_url, hops and too_many: at most MAX_REDIRECTS steps through (url, location)."""
    rows = urls.withColumns({"final_url": F.col(url_col), "hops": F.lit(0)})
    for _ in range(MAX_REDIRECTS):
        step = redirects.select(F.col("url").alias("__u"), F.col("location").alias("__l"))
        rows = rows.join(step, F.col("final_url") == F.col("__u"), "left")
        rows = rows.withColumns({"hops": F.col("hops") + F.col("__u").isNotNull().cast("int"), "final_url": F.coalesce("__l", "final_url")}).drop("__u", "__l")
    left = redirects.select(F.col("url").alias("__u")).distinct()
    return rows.join(left, F.col("final_url") == F.col("__u"), "left").withColumn("too_many", F.col("__u").isNotNull()).drop("__u")


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON indented by two; text that is no JSON stays, stripped."""

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x), indent=2, ensure_ascii=False)
        except ValueError:
            return x.strip()

    return text.map(one)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("lossy", T.BooleanType())]))
def decoded(body: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """Bytes as text by the declared charset, else UTF-8 with or without a mark; lossy if something had to be replaced."""

    def one(raw, charset):
        if raw is None:
            return None, False
        for name in (charset, "utf-8-sig"):
            try:
                if name:
                    return bytes(raw).decode(name), False
            except (LookupError, UnicodeDecodeError):
                continue
        return bytes(raw).decode("utf-8", "replace"), True

    return pd.DataFrame([one(b, c) for b, c in zip(body, declared)], columns=["text", "lossy"])


def compact_bytes(value: Column) -> Column:
    """Size of a value as compact JSON."""
    return F.octet_length(F.to_json(value))


def digest(*columns: str) -> Column:
    """SHA-256 over all rows' values, in a fixed order: for manifests and policies, which are small."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), 256)


LEVELS = (6, 4, 2, 0)  # hexadecimal digits of a row's hash that name its node, from the leaves up


def digest_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows`, `digest`: a SHA-256 over all rows' values that depends neither on their order nor on how they are dealt.

    A tree over the ranges of the rows' hashes: a leaf hashes its rows' hashes in order, each with how often it
    stands there, a node the digests of its children. A row that repeats is counted before it is shuffled, and a leaf
    is one of 16 million ranges, so no task holds more than that of a table of any size. Of no rows it is the
    SHA-256 of the empty text."""
    one = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    level = rows.select(one.alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    level = level.select(F.col("d").alias("at"), F.concat_ws(":", "d", F.col("n").cast("string")).alias("d"), "n")
    for digits in LEVELS:
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d"), F.sum("n").alias("n"))
        level = level.select("at", F.concat_ws(":", "at", "d").alias("d"), "n") if digits else level
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"))
