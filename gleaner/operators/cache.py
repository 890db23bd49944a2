"""Cache and snapshot algebra over append-only logs (key, stored_at as epoch seconds, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fresh(stored_at: Column, as_of: Column, ttl: float) -> Column:
    """Whether an entry still holds; the bound itself does."""
    return stored_at >= as_of - ttl


def document_fresh(stored_at: Column, retrieved_at: Column, as_of: Column, ttl: float) -> Column:
    """A document ages from its retrieval, and one from the future is not fresh."""
    return fresh(stored_at, as_of, ttl) & (as_of - retrieved_at).between(0, ttl)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last write of each key. A partial maximum in the tasks, so a hot key sends one row a task."""
    rest = [c for c in log.columns if c not in keys]
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return top.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def lookup(requests: DataFrame, entries: DataFrame, key: str, as_of: Column, ttl: float) -> DataFrame:
    """requests with the entry of their key where it is fresh, and `hit`."""
    kept = entries.filter(fresh(F.col("stored_at"), as_of, ttl)).withColumnRenamed(key, "__key")
    return requests.join(kept, F.col(key) == F.col("__key"), "left").withColumn("hit", F.col("__key").isNotNull()).drop("__key")


def lookup_as_of(requests: DataFrame, writes: DataFrame, key: str, at: str, ttl: float, id_col: str) -> DataFrame:
    """requests with `found_at` and `found_id`: the last write of their key at or before `at` and within ttl.

    Time is cut into spans of one ttl; a write is handed to its own span and the next, so each span of a key
    finds its writes by itself and a hot key spreads over its spans."""
    span = F.floor(F.col("t") / ttl)
    asked = requests.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("kind"), F.col(id_col).alias("id")).withColumn("span", span)
    put = writes.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(0).alias("kind"), F.col(id_col).alias("id"))
    put = put.select("*", F.explode(F.array(span, span + 1)).alias("span"))
    order = W.partitionBy("k", "span").orderBy("t", "kind", "id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("t", "id")), ignorenulls=True).over(order)
    rows = asked.unionByName(put).withColumn("w", last).filter("kind = 1")
    holds = F.col("t") - F.col("w.t") <= ttl
    found = rows.select(F.col("id").alias("__id"), F.when(holds, F.col("w.t")).alias("found_at"), F.when(holds, F.col("w.id")).alias("found_id"))
    return requests.join(found, F.col(id_col) == F.col("__id")).drop("__id")


def newest(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The n newest rows, ties by key: each task sends its n at most."""
    return rows.orderBy(F.desc("stored_at"), key).limit(n)


def prune(rows: DataFrame, as_of: Column, ttl: float, max_payload: int | None, max_rows: int, key: str) -> DataFrame:
    """What stays: not expired, then not oversized (in characters), then the newest max_rows."""
    left = rows.filter(fresh(F.col("stored_at"), as_of, ttl))
    if max_payload is not None:
        left = left.filter(F.length("payload") <= max_payload)
    return newest(left, max_rows, key)


def evict_reason(rows: DataFrame, as_of: Column, ttl: float, max_payload: int, max_rows: int, key: str) -> DataFrame:
    """rows with why each goes: expired, oversized, row_ceiling; null if it stays."""
    kept = prune(rows, as_of, ttl, max_payload, max_rows, key).select(F.col(key).alias("__key"))
    marked = rows.join(kept, F.col(key) == F.col("__key"), "left")
    reason = F.when(~fresh(F.col("stored_at"), as_of, ttl), "expired").when(F.length("payload") > max_payload, "oversized").when(F.col("__key").isNull(), "row_ceiling")
    return marked.withColumn("evict_reason", reason).drop("__key")


def keep_bytes(rows: DataFrame, ceiling: int, key: str, span: float = 3600.0) -> DataFrame:
    """The newest rows whose payload bytes add up to at most the ceiling, with `running_bytes`.

    The running sum is that of all later spans of time (a small table) plus that within the span."""
    rows = rows.withColumns({"__b": F.octet_length("payload").cast("long"), "__s": F.floor(F.col("stored_at") / span)})
    spans = rows.groupBy("__s").agg(F.sum("__b").alias("total"))
    later = W.partitionBy(F.lit(0)).orderBy(F.desc("__s")).rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(F.col("__s").alias("__of"), F.coalesce(F.sum("total").over(later), F.lit(0)).alias("later")).filter(F.col("later") <= ceiling)
    order = W.partitionBy("__s").orderBy(F.desc("stored_at"), key).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(spans, F.col("__s") == F.col("__of")).withColumn("running_bytes", F.sum("__b").over(order) + F.col("later"))
    return rows.filter(F.col("running_bytes") <= ceiling).drop("__b", "__s", "__of", "later")


def stats(rows: DataFrame, table_col: str) -> DataFrame:
    """Rows, characters and longest payload of each table."""
    return rows.groupBy(table_col).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length("payload")), F.lit(0)).alias("longest"))


def extend_cooldowns(log: DataFrame, key: str) -> DataFrame:
    """The cooldown in force of each key: one that ends earlier never replaces a later one."""
    return latest(log, [key], ["expires_at", "updated_at"])


def active_cooldowns(rows: DataFrame, as_of: Column, key: str) -> DataFrame:
    return rows.filter(F.col("expires_at") > as_of).orderBy(F.desc("expires_at"), key)


def prune_health(rows: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return rows.filter(~((F.col("updated_at") < as_of - days * 86400) & (F.col("expires_at") <= as_of)))


def snapshot_id(*parts: Column) -> Column:
    """32 hex digits that are the same in every attempt."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def parse_cursor(cursor: Column) -> Column:
    """(snapshot, offset) of 'hex32:offset'; null for anything else."""
    form = r"^([0-9a-f]{32}):([0-9]+)$"
    return F.when(cursor.rlike(form), F.struct(F.regexp_extract(cursor, form, 1).alias("snapshot"), F.regexp_extract(cursor, form, 2).try_cast("long").alias("offset")))


def payload_results(payload: Column) -> Column:
    """Whether a search payload is an old bare list, and its retrieval time (null for those)."""
    legacy = F.startswith(F.ltrim(payload), F.lit("["))
    return F.struct(legacy.alias("legacy"), F.when(~legacy, F.get_json_object(payload, "$.retrieved_at")).alias("retrieved_at"))


def touch_sessions(log: DataFrame, key: str, at: str, ttl: float, id_col: str) -> DataFrame:
    """log with `alive`: whether the key was touched within ttl before; each touch renews. ttl 0 keeps nothing."""
    before = F.lag(at).over(W.partitionBy(key).orderBy(at, id_col))
    return log.withColumn("alive", F.coalesce((F.col(at) - before < ttl), F.lit(False)))


def compact(spark, path: str, target: str, partitions: int) -> None:
    """Rewrites a log into fewer files."""
    spark.read.parquet(path).repartition(partitions).write.mode("overwrite").parquet(target)


# Bounds of the snapshots that cursors read, and of a healthy store.
SNAPSHOT_BYTES, SNAPSHOT_SECONDS, SNAPSHOT_ROWS, SNAPSHOT_TOTAL = 8_000_000, 3600, 100, 32_000_000
STORE_BYTES = 100_000_000


def put_snapshots(log: DataFrame, key: str) -> DataFrame:
    """The snapshots that a log of writes leaves: too large ones are refused, and what is there is never changed."""
    fits = log.filter(F.octet_length("payload") <= SNAPSHOT_BYTES)
    rest = [c for c in log.columns if c != key]
    first = fits.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("stored_at", *(c for c in rest if c != "stored_at"))).alias("__row"))
    return first.select(key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def live_snapshots(rows: DataFrame, as_of: Column, key: str, max_rows: int = SNAPSHOT_ROWS, total: int = SNAPSHOT_TOTAL, ttl: float = SNAPSHOT_SECONDS) -> DataFrame:
    """The snapshots that a cursor still finds: fresh, among the newest, and within the bytes for all."""
    return keep_bytes(newest(rows.filter(fresh(F.col("stored_at"), as_of, ttl)), max_rows, key), total, key).drop("running_bytes")


def storage_report(longest: Column, ceiling: float, store_bytes: Column) -> Column:
    """Warnings on the size of a store, each where it applies."""
    return F.array_compact(F.array(F.when(longest > ceiling, F.lit("document_over_ceiling")), F.when(store_bytes > STORE_BYTES, F.lit("store_over_100_mb"))))


def with_state(rows: DataFrame) -> DataFrame:
    """Rows of a store from before it kept a state, with an empty one."""
    return rows if "state" in rows.columns else rows.withColumn("state", F.lit("{}"))
