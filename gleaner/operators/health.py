"""Engine health: consecutive failures, back-off, status, leases and folds that depend on earlier acceptances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.functions.quality import failure_delay, local_fault, upstream_declared_wait

# Seconds.
LOCAL_CEILING, WEEK, UNVERIFIED_CEILING, DAY = 1800, 604800, 3600, 86400
MAX_DOUBLINGS = 8


def transitions(log: DataFrame, key: str = "engine", at: str = "at", id_col: str = "event_id") -> DataFrame:
    """The state after each observation of (key, at, id, failed, reason): consecutive_failures, suspension_report,
    delay_seconds, expires_at. A column retry_after, if there is one, is the least delay of its failure.

    Successes cut a key's history into islands. Within one, the count rises with each failure that is no
    'suspended' echo (an echo that comes first counts as one), the delay doubles with the count up to a ceiling,
    and the end of the wait only moves out. All of it is running sums and maxima."""
    by = W.partitionBy(key).orderBy(at, id_col)
    run = by.rowsBetween(W.unboundedPreceding, 0)
    rows = log.withColumn("__ok", (~F.col("failed")).cast("int")).withColumn("island", F.sum("__ok").over(run))
    inside = W.partitionBy(key, "island").orderBy(at, id_col).rowsBetween(W.unboundedPreceding, 0)
    echo = F.col("failed") & F.contains(F.lower(F.coalesce("reason", F.lit(""))), F.lit("suspended"))
    rows = rows.withColumn("__echo", echo)
    first_echo = F.first(F.when(F.col("failed"), F.col("__echo")), ignorenulls=True).over(inside)
    count = F.sum((F.col("failed") & ~F.col("__echo")).cast("int")).over(inside) + F.coalesce(first_echo, F.lit(False)).cast("int")
    rows = rows.withColumns({"consecutive_failures": F.when(F.col("failed"), count).otherwise(0), "suspension_report": echo})
    delay = back_off(F.col("reason"), F.col("consecutive_failures"), F.col("island") > 0, F.col("retry_after") if "retry_after" in log.columns else None)
    rows = rows.withColumn("delay_seconds", F.when(F.col("failed"), delay))
    expiry = F.max(F.col(at) + F.col("delay_seconds")).over(inside)
    return rows.withColumn("expires_at", F.when(F.col("failed"), expiry).otherwise(F.lit(0.0))).drop("__ok", "__echo")


def back_off(reason: Column, count: Column, answered: Column, retry_after: Column | None = None) -> Column:
    """Seconds to wait after the count-th failure in a row for this reason; `answered`: the engine has ever worked."""
    reason = F.coalesce(reason, F.lit(""))
    base = failure_delay(reason)
    known = local_fault(reason) | upstream_declared_wait(reason) | answered
    ceiling = F.when(local_fault(reason), LOCAL_CEILING).when(known, F.greatest(base, F.lit(WEEK))).otherwise(F.least(F.greatest(base, F.lit(WEEK)), F.lit(UNVERIFIED_CEILING)))
    delay = F.least(base * F.pow(F.lit(2), F.least(count - 1, F.lit(MAX_DOUBLINGS))), ceiling).cast("double")
    return delay if retry_after is None else F.greatest(delay, F.coalesce(retry_after.cast("double"), F.lit(0.0)))


def snapshot(states: DataFrame, as_of: Column, key: str = "engine", at: str = "at", id_col: str = "event_id", leases: DataFrame | None = None) -> DataFrame:
    """The status of each key at as_of from its transitions: untested, working, unverified, recovery_due, cooling_down, or
    recovering while a lease (key, granted_at, lease_until) runs that was granted after its last observation: any
    observation ends the leases before it. Echoes of a suspension are no failures of their own; they are counted apart."""
    seen = states.filter(F.col(at) <= as_of)
    last = seen.groupBy(key).agg(
        F.max_by(F.struct("consecutive_failures", "expires_at", "reason", "failed"), F.struct(at, id_col)).alias("s"),
        F.max(F.when(~F.col("failed"), F.col(at))).alias("last_success"), F.max(F.when(F.col("failed"), F.col(at))).alias("last_failure"),
        F.max(at).alias("__seen"), F.count_if(~F.col("failed")).alias("successes"), F.count_if(F.col("failed") & ~F.col("suspension_report")).alias("failures"), F.count_if("suspension_report").alias("suspension_reports"),
    )
    if leases is None:
        last = last.withColumn("lease", F.lit(0.0))
    else:
        held = leases.filter(F.col("granted_at") <= as_of).select(F.col(key).alias("__k"), "granted_at", "lease_until")
        held = last.select(key, "__seen").join(held, (F.col(key) == F.col("__k")) & (F.col("granted_at") >= F.col("__seen"))).groupBy("__k").agg(F.max("lease_until").alias("lease"))
        last = last.join(held, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("lease", F.coalesce("lease", F.lit(0.0)))
    until = F.col("s.expires_at")
    status = (
        F.when(F.col("lease") > as_of, "recovering")
        .when(until > as_of, "cooling_down")
        .when(F.col("s.consecutive_failures") > 0, "recovery_due")
        .when(F.col("last_success").isNull(), "untested")
        .when(as_of - F.col("last_success") <= DAY, "working")
        .otherwise("unverified")
    )
    why = F.when(F.col("s.failed"), F.coalesce("s.reason", F.lit("")))
    fault = F.when(why.isNull() | (why == ""), None).when(local_fault(why), "local_transport").otherwise("upstream")
    wait = F.greatest(until, F.col("lease"))
    return last.select(
        key, status.alias("status"), fault.alias("fault"), F.col("s.consecutive_failures").alias("consecutive_failures"), "successes", "failures", "suspension_reports",
        "last_success", "last_failure", F.when(wait > as_of, wait).alias("retry_at"), (until > as_of).alias("retry_time_is_estimate"),
    )


def health_line(status: Column, reason: Column, retry_at: Column, as_of: Column) -> Column:
    """'reason (Ns; status)' for engines that are left out."""
    wait = F.greatest(F.lit(0), F.floor(retry_at - as_of)).cast("int")
    return F.when(status.isin("cooling_down", "recovering", "disabled", "missing"), F.format_string("%s (%ds; %s)", reason, F.coalesce(wait, F.lit(0)), status))


def overlay_inventory(health: DataFrame, inventory: DataFrame, key: str = "engine") -> DataFrame:
    """Health with what the inventory knows: disabled and missing engines, and whether the configuration was seen."""
    rows = health.join(inventory.select(F.col(key).alias("__e"), "enabled"), F.col(key) == F.col("__e"), "left")
    status = F.when(F.col("__e").isNull(), "missing").when(~F.col("enabled"), "disabled").otherwise(F.col("status"))
    return rows.withColumn("configuration_verified", F.col("__e").isNotNull()).withColumn("status", status).drop("__e", "enabled")


def one_recovering(requests: DataFrame, request: str, order: str) -> DataFrame:
    """Of the engines of a request that are due to recover the first is tried; the rest are deferred."""
    rank = F.row_number().over(W.partitionBy(request, F.col("status") == "recovery_due").orderBy(order))
    return requests.withColumn("deferred", (F.col("status") == "recovery_due") & (rank > 1))


def epochs(log: DataFrame, key: str, config: str, at: str, id_col: str) -> DataFrame:
    """log with `epoch`, which rises where a key's configuration changes; evidence is folded within an epoch."""
    by = W.partitionBy(key).orderBy(at, id_col)
    changed = F.coalesce((~F.col(config).eqNullSafe(F.lag(config).over(by))) & F.lag(at).over(by).isNotNull(), F.lit(False))
    return log.withColumn("__c", changed.cast("int")).withColumn("epoch", F.sum("__c").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("__c")


def fold(log: DataFrame, key: str, order: list[str], step: Callable, out: str, kind: T.DataType, span: str | None = None) -> DataFrame:
    """log with a column made by a fold over each key's rows in order; step(state, row) -> (state, value), rows as
    dicts, state None at first. Where acceptance depends on earlier acceptances no window can express it. Rows
    stream through sorted, so a key's history is never held; `span` names a column that splits a key into
    stretches that are independent of each other, so that a hot key spreads over tasks."""
    part = [key] if span is None else [key, span]
    schema = T.StructType([*log.schema, T.StructField(out, kind)])
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            values = []
            for row in batch.to_pylist():
                group = tuple(row[c] for c in part)
                if group != now:
                    now, state = group, None
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow_kind)], names=[*batch.schema.names, out])

    return log.repartition(*part).sortWithinPartitions(*part, *order).mapInArrow(run, schema)


def gap_span(log: DataFrame, key: str, at: str, gap: float, id_col: str) -> DataFrame:
    """log with `stretch`, which rises where a key rests longer than `gap`: no fixed-length hold reaches over it."""
    by = W.partitionBy(key).orderBy(at, id_col)
    new = F.coalesce((F.col(at) - F.lag(at).over(by) > gap).cast("int"), F.lit(0))
    return log.withColumn("__new", new).withColumn("stretch", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def claims(log: DataFrame, key: str, at: str, seconds: float, id_col: str, out: str = "granted", inclusive: bool = False, stored: str | None = None) -> DataFrame:
    """log with `granted`: a claim is granted unless an earlier granted one of its key still runs, with `inclusive` up to
    and with its last moment. This is also how requests share a call in flight (granted: the call's leader) and how a cache of
    a ttl answers (granted: a miss that writes; a hit does not renew). `stored` names a flag of what is kept: an empty
    answer is a miss that leaves nothing behind."""

    def step(until, row):
        now = row[at]
        if until is not None and (now < until or (inclusive and now == until)):
            return until, False
        return (now + seconds if stored is None or row[stored] else until), True

    rows = gap_span(log, key, at, seconds, id_col)
    return fold(rows, key, [at, id_col], step, out, T.BooleanType(), "stretch").drop("stretch")
