"""The folds of `operators.health` over streams, with keyed state.

Rows of a micro-batch are taken in the order of (at, id) within their key; a row that arrives in a
later batch is judged by the state that it then finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.functions.quality import failure_delay, local_fault, upstream_declared_wait
from gleaner.operators.availability import lease_step
from gleaner.operators.health import LOCAL_CEILING, MAX_DOUBLINGS, UNVERIFIED_CEILING, WEEK


def claims_stream(events: DataFrame, key: str, at: str, seconds: float, id_col: str, out: str = "granted", inclusive: bool = False, stored: str | None = None) -> DataFrame:
    """(key, id, at, granted): leases, shared calls and cache misses as `operators.health.claims` grants them."""
    kinds = dict(events.dtypes)
    kept = F.lit(True) if stored is None else F.coalesce(F.col(stored), F.lit(False))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values([at, id_col], kind="stable")
        granted = []
        for now, keeps in zip(rows[at], rows["__kept"]):
            granted.append(now > until or (now == until and not inclusive))
            if granted[-1] and keeps:
                until = now + seconds
        state.update((until,))
        yield rows[[key, id_col, at]].assign(**{out: granted})

    schema = f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, {at} {kinds[at]}, {out} boolean"
    return events.select(key, id_col, at, kept.alias("__kept")).groupBy(key).applyInPandasWithState(run, schema, "until double", "append", GroupStateTimeout.NoTimeout)


def health_stream(events: DataFrame, key: str = "engine", at: str = "at", id_col: str = "event_id") -> DataFrame:
    """(key, id, at, consecutive_failures, delay_seconds, expires_at) of (key, id, at, failed, reason, started_at):
    back-off as `operators.health.transitions` computes it; a success that started before the last failure is ignored."""
    kinds = dict(events.dtypes)
    reason = F.coalesce("reason", F.lit(""))
    started = F.col("started_at").cast("double") if "started_at" in events.columns else F.lit(None).cast("double")
    rows = events.select(
        key, id_col, at, "failed", failure_delay(reason).cast("double").alias("base"), local_fault(reason).alias("local"), upstream_declared_wait(reason).alias("declared"),
        F.contains(F.lower(reason), F.lit("suspended")).alias("echo"), started.alias("started"),
    )

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, expires, successes, last = state.get if state.exists else (0, 0.0, 0, float("-inf"))
        pdf = pd.concat(list(batches)).sort_values([at, id_col], kind="stable")
        out = []
        for r in pdf.to_dict("records"):
            delay = None
            if r["failed"]:
                count = max(1, count) if r["echo"] else count + 1
                ceiling = LOCAL_CEILING if r["local"] else max(r["base"], WEEK)
                if not (r["local"] or r["declared"] or successes):
                    ceiling = min(ceiling, UNVERIFIED_CEILING)
                delay = float(min(r["base"] * 2 ** min(count - 1, MAX_DOUBLINGS), ceiling))
                expires, last = max(expires, r[at] + delay), r[at]
            elif pd.isna(r["started"]) or last <= r["started"]:
                count, expires, successes = 0, 0.0, successes + 1
            out.append((r[key], r[id_col], r[at], count, delay, expires))
        state.update((int(count), float(expires), int(successes), float(last)))
        yield pd.DataFrame(out, columns=[key, id_col, at, "consecutive_failures", "delay_seconds", "expires_at"])

    schema = f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, {at} {kinds[at]}, consecutive_failures long, delay_seconds double, expires_at double"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "count long, expires double, successes long, last double", "append", GroupStateTimeout.NoTimeout)


def availability_stream(events: DataFrame, key: str = "engine", at: str = "at", id_col: str = "event_id") -> DataFrame:
    """(key, id, applied, consecutive_failures, retry_at, lease_until) of (key, id, at, kind, reason, retry_after, started_at, token,
    seconds, config): observations, claims, releases and changes of configuration as `operators.availability.leased` folds them."""
    kinds = dict(events.dtypes)
    reason = F.coalesce("reason", F.lit(""))
    rows = events.select(
        key, id_col, at, "kind", "token", "seconds", "config", F.col("started_at").cast("double").alias("started"), F.coalesce(F.col("retry_after").cast("double"), F.lit(0.0)).alias("least"),
        failure_delay(reason).cast("double").alias("base"), local_fault(reason).alias("local"), upstream_declared_wait(reason).alias("declared"), F.contains(F.lower(reason), F.lit("suspended")).alias("echo"),
    )

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, config, count, worked, last, expires, token, until, rest = state.get if state.exists else (False, None, 0, False, None, 0.0, None, 0.0, 0.0)
        out = []
        for r in pd.concat(list(batches)).astype(object).sort_values([at, id_col], kind="stable").to_dict("records"):
            r = {k: None if pd.isna(v) else v for k, v in r.items()}
            if known and r["config"] != config:
                count, worked, last, expires, token, until, rest = 0, False, None, 0.0, None, 0.0, 0.0
            known, config, accepted = True, r["config"], True
            if r["kind"] == "failed":
                count = max(1, count) if r["echo"] else count + 1
                ceiling = LOCAL_CEILING if r["local"] else max(r["base"], WEEK)
                if not (r["local"] or r["declared"] or worked):
                    ceiling = min(ceiling, UNVERIFIED_CEILING)
                expires, last = max(expires, r[at] + max(min(r["base"] * 2 ** min(count - 1, MAX_DOUBLINGS), ceiling), r["least"])), r[at]
            elif r["kind"] == "succeeded":
                accepted = last is None or r["started"] is None or last <= r["started"]
                if accepted:
                    count, worked, expires = 0, True, 0.0
            (token, until, rest), told = lease_step((token, until, rest), r | {"accepted": accepted, "expires_at": expires}, at)
            out.append((r[key], r[id_col], told["applied"], count, told["retry_at"], told["lease_until"]))
        state.update((known, config, count, worked, last, float(expires), token, float(until), float(rest)))
        yield pd.DataFrame(out, columns=[key, id_col, "applied", "consecutive_failures", "retry_at", "lease_until"])

    schema = f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, applied boolean, consecutive_failures long, retry_at double, lease_until double"
    held = f"known boolean, config {kinds['config']}, count long, worked boolean, last double, expires double, token string, until double, rest double"
    return rows.groupBy(key).applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.NoTimeout)


def latest_stream(writes: DataFrame, path: str, checkpoint: str):
    """A cache sink: each micro-batch is appended to the log that `operators.cache.latest` reads."""

    def put(batch: DataFrame, _: int) -> None:
        batch.select("key", "stored_at", "payload").write.mode("append").parquet(path)

    return writes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
