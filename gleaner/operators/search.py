"""Search results: rank, first-wins dedupe, limit, attribution, engine selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import SNIPPET_CAP, TITLE_CAP, first_published
from gleaner.functions.urls import canonical_url

# The shape of a captured response, and caps on its failures.
RESPONSE = "results array<struct<url:string,title:string,content:string,engines:variant,engine:variant,publishedDate:string,published_at:string,date:string,score:variant>>"
MAX_FAILURES, ENGINE_CAP, REASON_CAP = 12, 64, 240


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _names(value: Column) -> Column:
    """The names that a JSON value gives: a text as one, each entry of a list as text; null where it gives none and
    another value may, as an empty text or list, zero and false do."""
    one = F.try_variant_get(value, "$", "string")
    text = lambda v: F.when(F.is_variant_null(v), "None").when(_kind(v) == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).otherwise(F.try_variant_get(v, "$", "string"))
    entries = F.transform(F.try_variant_get(value, "$", "array<variant>"), text)
    some = F.array().cast("array<string>")
    return (
        F.when(value.isNull() | F.is_variant_null(value), None)
        .when(_kind(value) == "STRING", F.when(one != "", F.array(one)))
        .when(F.startswith(_kind(value), F.lit("ARRAY")), F.when(F.size(entries) > 0, entries))
        .when(one.isin("0", "0.0", "false", "{}"), None)
        .otherwise(some)
    )


def parse_results(responses: DataFrame, key: str, body_col: str) -> DataFrame:
    """A row for each result of each JSON body: key, rank (its 1-based place, never renumbered), url, title, snippet, engines, published_at, score."""
    rows = responses.select(key, F.posexplode(F.from_json(body_col, RESPONSE)["results"]).alias("pos", "r")).filter("r.url is not null and r.url <> ''")
    rows = rows.withColumn("canonical", canonical_url(F.col("r.url"))).filter("canonical is not null")
    engines = F.coalesce(_names(F.col("r.engines")), _names(F.col("r.engine")), F.array().cast("array<string>"))
    return rows.select(
        key, (F.col("pos") + 1).alias("rank"), F.col("r.url").alias("url"), "canonical",
        F.trim(F.coalesce(F.nullif(F.col("r.title"), F.lit("")), "canonical")).alias("title"), F.trim(F.coalesce("r.content", F.lit(""))).alias("snippet"),
        engines.alias("engines"), first_published(F.col("r.publishedDate"), F.col("r.published_at"), F.col("r.date")).alias("published_at"), F.coalesce(F.try_variant_get("r.score", "$", "double"), F.lit(0.0)).alias("score"),
    )


def first_wins(rows: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Of the results of a key (canonical, rank) with one canonical URL the first stays, with its rank; then the first `limit`."""
    kept = rows.withColumn("__n", F.row_number().over(W.partitionBy(key, "canonical").orderBy("rank"))).filter("__n = 1").drop("__n")
    if limit is not None:
        kept = kept.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("rank"))).filter(F.col("__n") <= limit).drop("__n")
    return kept


def engine_counts(rows: DataFrame) -> DataFrame:
    """Results each engine is named for."""
    return rows.select(F.explode("engines").alias("engine")).groupBy("engine").agg(F.count("*").alias("results"))


def coverage(requested: Column, answered: Column, waiting: Column, results: Column, status: Column | None = None) -> Column:
    """answered (in lower case, sorted), the requested engines that neither answered nor wait, whatever the case, whether results
    say which engine they are from ("absent" only if there are results and none does), and which never worked by `status`,
    a map of engine to (status, successes)."""
    low = lambda names: F.transform(names, lambda x: F.lower(x))
    heard = F.array_sort(F.array_distinct(low(answered)))
    silent = F.filter(requested, lambda x: ~F.array_contains(F.array_union(heard, low(waiting)), F.lower(x)))
    never = F.filter(requested, lambda x: (F.try_element_at(status, x)["status"] == "untested") & (F.coalesce(F.try_element_at(status, x)["successes"], F.lit(0)) == 0)) if status is not None else F.array().cast("array<string>")
    return F.struct(heard.alias("answered"), silent.alias("silent"), F.when((F.size(heard) > 0) | (results == 0), "present").otherwise("absent").alias("attribution"), F.coalesce(never, F.array().cast("array<string>")).alias("never_verified"))


def available(configured: Column, cooling: Column, known: Column, backend: str = "searxng") -> Column:
    """The configured engines without a cooldown; none while their health is unknown or the backend itself cools down."""
    low = F.transform(cooling, lambda x: F.lower(x))
    free = F.filter(configured, lambda x: ~F.array_contains(low, F.lower(x)))
    return F.when(known & ~F.array_contains(low, F.lit(backend)), free).otherwise(F.array().cast("array<string>"))


def as_hit(title: Column, snippet: Column) -> Column:
    """Title and snippet as far as an answer carries them."""
    return F.struct(F.substring(title, 1, TITLE_CAP).alias("title"), F.substring(snippet, 1, SNIPPET_CAP).alias("snippet"))


def without_empty(**fields: Column) -> Column:
    """A JSON object of the fields that say something: no nulls, no empty lists or maps, no false."""
    def kept(c: Column, kind: str) -> Column:
        return F.when(F.size(c) > 0, c) if kind == "list" else F.when(c, c) if kind == "flag" else c

    return F.to_json(F.struct(*(kept(c, n.split("__")[0]).alias(n.split("__")[-1]) for n, c in fields.items())))


def not_cooling(requested: DataFrame, cooling: DataFrame, col: str = "engine") -> DataFrame:
    """Requested engines without a cooldown, whatever their case."""
    return requested.join(cooling.select(F.lower(col).alias("__c")).distinct(), F.lower(F.col(col)) == F.col("__c"), "left_anti")


def cooling_of(requested: DataFrame, cooling: DataFrame, col: str = "engine") -> DataFrame:
    return requested.join(cooling.select(F.lower(col).alias("__c")).distinct(), F.lower(F.col(col)) == F.col("__c"), "left_semi")


def inventory_check(requested: DataFrame, inventory: DataFrame, page: Column, time_range: Column) -> DataFrame:
    """requested (engine) with `skipped`: why an engine cannot take the request, the first reason of this order, or null."""
    rows = requested.join(inventory.withColumnRenamed("engine", "__e"), F.col("engine") == F.col("__e"), "left")
    reason = (
        F.when(F.col("__e").isNull(), "missing")
        .when(~F.col("enabled"), "disabled")
        .when((page > 1) & ~F.col("paging"), "paging_unsupported")
        .when(time_range.isNotNull() & ~F.col("time_range_support"), "time_filter_unsupported")
    )
    return rows.withColumn("skipped", reason).drop("__e", "enabled", "paging", "time_range_support")


def unresponsive(body: Column) -> Column:
    """(engine, reason) of a response's unresponsive_engines: lists, objects or names, at most MAX_FAILURES, each once."""
    raw = F.slice(F.from_json(F.get_json_object(body, "$.unresponsive_engines"), "array<string>"), 1, MAX_FAILURES)

    def one(item: Column) -> Column:
        text = F.trim(item)
        parts = F.filter(F.transform(F.from_json(text, "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
        as_list = F.struct(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("unknown")).alias("engine"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("unresponsive")).alias("reason"))
        field = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(text, f"$.{n}"), F.lit("")) for n in names))
        as_object = F.struct(F.trim(F.coalesce(field("engine", "name"), F.lit("unknown"))).alias("engine"), F.trim(F.coalesce(field("error", "message"), F.lit("unresponsive"))).alias("reason"))
        as_name = F.struct(F.substring(text, 1, ENGINE_CAP).alias("engine"), F.lit("unresponsive").alias("reason"))
        return F.when(F.startswith(text, F.lit("[")), as_list).when(F.startswith(text, F.lit("{")), as_object).otherwise(as_name)

    cut = lambda p: F.struct(F.substring(p["engine"], 1, ENGINE_CAP).alias("engine"), F.substring(p["reason"], 1, REASON_CAP).alias("reason"))
    return F.array_distinct(F.transform(F.array_distinct(F.transform(F.coalesce(raw, F.array().cast("array<string>")), one)), cut))


def request_key(*arguments: Column) -> Column:
    """Identity of a request: a hash of its arguments as JSON, in which 1 and "1", null and "" differ."""
    return F.sha2(F.to_json(F.struct(*(a.alias(f"a{k}") for k, a in enumerate(arguments))), {"ignoreNullFields": "false"}), 256)


def fixture_route(queries: DataFrame, routes: DataFrame, query_col: str) -> DataFrame:
    """queries with the first route (route, pattern, a small table) whose pattern matches, whatever the case; -1 if none."""
    table = routes.agg(F.array_sort(F.collect_list(F.struct("route", "pattern"))).alias("__routes"))
    rows = queries.crossJoin(F.broadcast(table))
    hit = F.filter("__routes", lambda r: F.regexp_like(query_col, F.concat(F.lit("(?i)"), r["pattern"])))
    return rows.withColumn("route", F.coalesce(F.try_element_at(hit, F.lit(1))["route"], F.lit(-1))).drop("__routes")
