"""Requests answered from captured responses: redirects followed, large bodies refused, answers kept for a while.

Responses are read by Spark's JSON reader, which splits the files of an archive by ranges of bytes, so a capture of
any size is read in parallel. What a request gets is what was captured last before it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.urls import canonical_url
from gleaner.operators.calls import stretches
from gleaner.operators.health import fold
from gleaner.sources.staging import staged

# Redirects that are followed, and bytes of a body.
MAX_REDIRECTS, MAX_BYTES = 5, 5_000_000
RESPONSES = "url string, captured_at double, status int, location string, content_type string, content_length long, body string"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses, a JSON object a line; lines that are none have null columns and answer nothing."""
    return spark.read.schema(RESPONSES).json(path)


def _as_of(requests: DataFrame, held: DataFrame, id_col: str, identity: Callable[[Column], Column]) -> DataFrame:
    """requests (at, __url) with the response captured last at or before `at` as `__r`, or null. Both sides are laid in one
    row of moments a URL; a request takes the last response before it, so no pairs are made."""
    left = requests.withColumns({"__key": identity(F.col("__url")), "__at": F.col("at"), "__late": F.lit(1)})
    before = W.partitionBy("__key").orderBy("__at", "__late", "__order", F.col(id_col)).rowsBetween(W.unboundedPreceding, 0)
    rows = held.unionByName(left, allowMissingColumns=True)
    rows = rows.withColumn("__r", F.when(F.col("__key").isNotNull(), F.last("__r", ignorenulls=True).over(before)))
    return rows.filter("__late = 1").drop("__key", "__at", "__late", "__order")


def fetched(requests: DataFrame, responses: DataFrame, id_col: str = "request_id", max_bytes: int = MAX_BYTES, follow: int = MAX_REDIRECTS, identity: Callable[[Column], Column] = canonical_url, response_id: str | None = None) -> DataFrame:
    """requests (id, url, at) with final_url, hops, status, content_type, body and error.

    A response with a location and a status of 301, 302, 303, 307 or 308 leads on, at most `follow` times. error:
    not_captured, too_many_redirects, or too_large for a declared or real length over `max_bytes` (the body is then
    null). URLs are one if they have the same `identity`, their canonical forms if nothing else is said; one that has none
    is not captured. Of responses of one moment the one with the largest `response_id` counts, or the one with the
    largest values if they have no id."""
    rows = requests.withColumns({"__url": F.col("url"), "__hops": F.lit(0), "__goes": F.lit(True)})
    answer = F.struct("captured_at", "status", "location", "content_type", "content_length", "body").alias("__r")
    order = F.col(response_id) if response_id else F.struct("status", "location", "content_type", "content_length", "body")
    held = responses.select(identity(F.col("url")).alias("__key"), F.col("captured_at").alias("__at"), answer, F.lit(0).alias("__late"), order.alias("__order")).filter("__key is not null")
    held, _ = staged(held)
    done: list[DataFrame] = []
    for hop in range(follow + 1):
        rows, _ = staged(_as_of(rows.drop("__r"), held, id_col, identity))  # read twice: what ends here, and what is led on
        leads = F.coalesce(F.col("__r.status").isin(301, 302, 303, 307, 308) & (F.col("__r.location") != ""), F.lit(False))
        done.append(rows.filter(~leads) if hop < follow else rows.withColumn("__goes", ~leads))
        rows = rows.filter(leads)
        if hop < follow and rows.isEmpty():
            break
        rows = rows.withColumns({"__url": absolute(F.col("__r.location"), F.col("__url")), "__hops": F.col("__hops") + 1})
    size = F.greatest(F.coalesce(F.col("__r.content_length"), F.lit(0)), F.coalesce(F.octet_length("__r.body"), F.lit(0)))
    error = F.when(F.col("__r").isNull(), "not_captured").when(~F.col("__goes"), "too_many_redirects").when(size > max_bytes, "too_large")
    out = reduce(DataFrame.unionByName, done).withColumns({"final_url": F.col("__url"), "hops": F.col("__hops"), "status": F.col("__r.status"), "content_type": F.col("__r.content_type"), "error": error})
    return out.withColumn("body", F.when(F.col("error").isNull(), F.col("__r.body"))).drop("__url", "__hops", "__goes", "__r")


def absolute(location: Column, base: Column) -> Column:
    """A location against the URL that gave it: whole, without scheme, from the root, or beside the last step of the path."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)?", 1)
    return (
        F.when(location.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), location)
        .when(F.startswith(location, F.lit("//")), F.concat(scheme, location))
        .when(F.startswith(location, F.lit("/")), F.concat(root, location))
        .otherwise(F.concat(root, F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), location))
    )


def stored(requests: DataFrame, ttl: float, id_col: str = "request_id", width: float = 86400.0) -> DataFrame:
    """requests (id, url, at) with `looks`: whether a request goes out, as no answer of its URL from within `ttl` seconds is
    kept; one from the last moment still is, and an answer that is used is not renewed."""
    def step(until, row):
        looks = until is None or row["at"] > until
        return (row["at"] + ttl if looks else until), looks

    rows = requests.withColumn("__key", F.coalesce(canonical_url(F.col("url")), F.col("url")))
    rows = stretches(rows, "__key", "at", id_col, F.col("at") + ttl + 1e-6, width)
    return fold(rows, "__key", ["at", id_col], step, "looks", T.BooleanType(), "stretch").drop("__key", "stretch")
