"""Calls that run for a while: shared calls with real durations, and an inventory that is read again when it is stale.

What a row does depends on what ran when it came, and that on the rows before it. But nothing runs on past the latest
end of the rows before, so a key's log falls into stretches that know nothing of each other. Their bounds are running
maxima, worked out by buckets of time (`availability.Scan`); each stretch is folded in one pass of sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.availability import BUCKET, Scan
from gleaner.operators.health import fold

# Seconds that an inventory holds, and that a failed look at it does.
FRESH, FAILED = 900.0, 60.0


def stretches(log: DataFrame, key: str, at: str, id_col: str, ends: Column, width: float = BUCKET) -> DataFrame:
    """log with `stretch`, which rises where a row comes when all rows of its key before it have ended."""
    scan = Scan(log.withColumn("__end", ends), [at, id_col], F.floor(F.col(at) / width))
    scan.running([key], exclusive=True, __last=("max", F.col("__end")))
    scan.put(__new=F.coalesce((F.col(at) >= F.col("__last")).cast("long"), F.lit(0)))
    scan.running([key], stretch=("sum", F.col("__new")))
    return scan.rows.drop("__bucket", "__end", "__last", "__new")


CALL = T.StructType([T.StructField("leader", T.BooleanType()), T.StructField("call", T.LongType()), T.StructField("served", T.BooleanType()), T.StructField("leaves_at", T.DoubleType())])


def shared_calls(requests: DataFrame, key: str, at: str, id_col: str, seconds: str, patience: str, width: float = BUCKET) -> DataFrame:
    """requests with `shared`: whether it starts a call (leader), the id of the request that did, whether the call ends
    before the request gives up (served), and when it leaves.

    A call takes the seconds of its leader. It is in flight until it ends, or until the last request that waits for it
    has given up, which stops it; a request waits for `patience` seconds at most (null: till the end). One that comes at
    the very moment of an end starts a new call. Negative or null seconds take no time. Ties go by id."""

    def step(state, row):
        now, took = row[at], max(0.0, row[seconds] or 0.0)
        gives_up = float("inf") if row[patience] is None else now + max(0.0, row[patience])
        leader = state is None or now >= min(state[1], state[2])
        call, end, last = (row[id_col], now + took, gives_up) if leader else (state[0], state[1], max(state[2], gives_up))
        return (call, end, last), {"leader": leader, "call": call, "served": end <= gives_up, "leaves_at": min(end, gives_up)}

    end = F.col(at) + F.greatest(F.lit(0.0), F.coalesce(F.col(seconds), F.lit(0.0)))
    return fold(stretches(requests, key, at, id_col, end, width), key, [at, id_col], step, "shared", CALL, "stretch").drop("stretch")


LOOK = T.StructType([T.StructField("looked", T.BooleanType()), T.StructField("version", T.LongType()), T.StructField("verified", T.BooleanType()), T.StructField("refresh_after", T.DoubleType())])


def inventory_looks(requests: DataFrame, key: str, at: str, id_col: str, answers: str, force: str | None = None, width: float = BUCKET) -> DataFrame:
    """requests with `inventory`: whether the request looks at the backend (looked), the id of the look whose outcome it
    goes by (version), whether that look succeeded (verified), and until when it holds.

    `answers` tells whether a look at that moment would succeed. The outcome holds for FRESH seconds, a failure for FAILED,
    the last moment excluded. `force` names a flag of requests that look in any case. A null answer is a failure."""

    def step(state, row):
        now = row[at]
        if state is None or now >= state[2] or (force and row[force]):
            state, looked = (row[id_col], bool(row[answers]), now + (FRESH if row[answers] else FAILED)), True
        else:
            looked = False
        return state, dict(zip(LOOK.names, (looked, *state)))

    ends = F.col(at) + F.when(F.col(answers), FRESH).otherwise(FAILED)
    return fold(stretches(requests, key, at, id_col, ends, width), key, [at, id_col], step, "inventory", LOOK, "stretch").drop("stretch")


def inventory_versions(requests: DataFrame, key: str, at: str, id_col: str, answers: str, fingerprint: str, width: float = BUCKET) -> DataFrame:
    """The looks that succeeded, one version each: key, version, valid_from, valid_to, fingerprint, and whether evidence about
    engines is to be forgotten because the fingerprint differs from the version before."""
    looks = inventory_looks(requests, key, at, id_col, answers, width=width).filter("inventory.looked AND inventory.verified")
    scan = Scan(looks.select(key, id_col, at, fingerprint), [at, id_col], F.floor(F.col(at) / width))
    scan.running([key], exclusive=True, __was=("last", F.struct(F.col(fingerprint).alias("f"))))
    reset = F.col("__was").isNotNull() & ~F.col("__was.f").eqNullSafe(F.col(fingerprint))
    return scan.rows.select(key, F.col(id_col).alias("version"), F.col(at).alias("valid_from"), (F.col(at) + FRESH).alias("valid_to"), fingerprint, F.coalesce(reset, F.lit(False)).alias("reset"))
