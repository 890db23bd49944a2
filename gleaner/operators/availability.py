"""Engine availability over a log of observations, leases and configurations, for keys of any size.

What an observation leaves behind follows from running sums, maxima and firsts, so it is worked out in two passes:
within buckets of time of a key, then over the few totals of its buckets, whose carry is added. No task ever holds
or walks more of a key than a bucket. Leases depend on each other, but every accepted observation ends them and says
from when the engine may be tried, so they are folded between two observations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.health import back_off, fold
from gleaner.sources.staging import dropped, staged

INCONCLUSIVE = 120.0  # fixed value: seconds that an engine rests after a probe that showed nothing
BUCKET = 86400.0


class Scan:
    """Rows with running values, added one step after the other. Each step reads the rows twice, once for the totals of
    its buckets, so it writes what the steps before have made; what they wrote is deleted."""

    def __init__(self, rows: DataFrame, order: list[str], bucket: Column):
        self.rows, self.order, self.path = rows.withColumn("__bucket", bucket), order, None

    def running(self, part: list[str], exclusive: bool = False, **wanted: tuple[str, Column]) -> None:
        """Adds running values over `part` in order; wanted: name=(sum, max, first or last, column), nulls left out.
        No window spans more than a bucket, or a row a bucket."""
        rows = self.rows.withColumns({f"__in_{n}": c for n, (_, c) in wanted.items()})
        rows, path = staged(rows)
        self.forget()
        self.path, place = path, F.struct(*self.order)
        rows = rows.withColumn("__group", F.struct(*part, "__bucket"))  # equal where nulls are, so the join takes rows as the window has dealt them
        inside = W.partitionBy("__group").orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        before = W.partitionBy(*(F.col("__of")[c] for c in part)).orderBy(F.col("__of.__bucket")).rowsBetween(W.unboundedPreceding, -1)
        totals = rows.groupBy(F.col("__group").alias("__of")).agg(*(WHOLE[kind](F.col(f"__in_{n}"), place).alias(f"__of_{n}") for n, (kind, _) in wanted.items()))
        totals = totals.select("__of", *(OVER[kind](f"__of_{n}").over(before).alias(f"__to_{n}") for n, (kind, _) in wanted.items()))
        rows = rows.withColumns({f"__at_{n}": OVER[kind](f"__in_{n}").over(inside) for n, (kind, _) in wanted.items()})
        rows = rows.join(totals, F.col("__group") == F.col("__of"), "left")
        rows = rows.withColumns({n: BOTH[kind](F.col(f"__to_{n}"), F.col(f"__at_{n}")) for n, (kind, _) in wanted.items()})
        self.rows = rows.drop("__group", "__of", *(f"__{at}_{n}" for n in wanted for at in ("in", "at", "to")))

    def put(self, **columns: Column) -> None:
        self.rows = self.rows.withColumns(columns)

    def forget(self) -> None:
        if self.path:
            dropped(self.rows.sparkSession, self.path)
            self.path = None


# How values run within a bucket, sum up over it, and join what ran before it.
OVER = {"sum": F.sum, "max": F.max, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}
WHOLE = {"sum": lambda c, at: F.sum(c), "max": lambda c, at: F.max(c), "first": lambda c, at: F.min_by(c, F.when(c.isNotNull(), at)), "last": lambda c, at: F.max_by(c, F.when(c.isNotNull(), at))}
BOTH = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "first": lambda a, b: F.coalesce(a, b), "last": lambda a, b: F.coalesce(b, a)}


def observed(log: DataFrame, key: str = "engine", at: str = "at", id_col: str = "event_id", config: str | None = None, width: float = BUCKET) -> DataFrame:
    """log with what each observation leaves behind: epoch, accepted, consecutive_failures, suspension_report,
    delay_seconds, expires_at. Rows have `failed` (null: no observation) and reason; if there, `retry_after` is the
    least delay of a failure, `started_at` the moment a success was asked for: one that a failure came after is late
    and changes nothing, and `config` what the engine runs with: where it changes all evidence is forgotten.

    Equals `health.transitions` on logs without late successes and changes of configuration. A null or empty reason
    is a failure for no known cause; ties go by id; an empty log gives no rows."""
    return _observed(log, key, at, id_col, config, width).rows.drop("__bucket", "__island", "__stretch", "__n", "__first", "__expiry")


def _observed(log: DataFrame, key: str, at: str, id_col: str, config: str | None, width: float) -> Scan:
    scan = Scan(log, [at, id_col], F.floor(F.col(at) / width))
    if config is None:
        scan.put(epoch=F.lit(0).cast("long"))
    else:
        scan.running([key], exclusive=True, __was=("last", F.struct(F.col(config).alias("c"))))
        changed = F.col("__was").isNotNull() & ~F.col("__was.c").eqNullSafe(F.col(config))
        scan.put(__changed=F.coalesce(changed, F.lit(False)).cast("long"))
        scan.running([key], epoch=("sum", F.col("__changed")))
        scan.rows = scan.rows.drop("__was", "__changed")
    failed, worked = F.coalesce(F.col("failed"), F.lit(False)), F.coalesce(~F.col("failed"), F.lit(False))
    late = F.lit(False)
    if "started_at" in log.columns:
        scan.running([key, "epoch"], exclusive=True, __failure=("max", F.when(failed, F.col(at))))
        late = F.coalesce(worked & (F.col("__failure") > F.col("started_at")), F.lit(False))
    scan.put(accepted=F.when(F.col("failed").isNotNull(), ~late), suspension_report=failed & F.contains(F.lower(F.coalesce("reason", F.lit(""))), F.lit("suspended")))
    scan.rows = scan.rows.drop("__failure")
    scan.running([key, "epoch"], __island=("sum", (worked & F.col("accepted")).cast("long")), __stretch=("sum", F.coalesce("accepted", F.lit(False)).cast("long")))
    scan.running([key, "epoch", "__island"], __n=("sum", (failed & ~F.col("suspension_report")).cast("long")), __first=("first", F.when(failed, F.col("suspension_report"))))
    scan.put(consecutive_failures=F.when(worked & F.col("accepted"), 0).otherwise(F.col("__n") + F.coalesce(F.col("__first"), F.lit(False)).cast("long")))
    delay = back_off(F.col("reason"), F.col("consecutive_failures"), F.col("__island") > 0, F.col("retry_after") if "retry_after" in log.columns else None)
    scan.put(delay_seconds=F.when(failed, delay))
    scan.running([key, "epoch", "__island"], __expiry=("max", F.col(at) + F.col("delay_seconds")))
    scan.put(expires_at=F.coalesce("__expiry", F.lit(0.0)))
    return scan


def lease_step(held: tuple[str | None, float, float] | None, row: dict, at: str = "at") -> tuple[tuple[str | None, float, float], dict]:
    """(token, until, rest) of an engine after a row of an availability log. A claim is granted if the engine neither
    rests nor is leased; a release counts if it names the token that is held, and after an inconclusive one the
    engine rests for a while; an accepted observation ends any lease."""
    token, until, rest = held or (None, 0.0, 0.0)
    now, kind, applied = row[at], row["kind"], False
    rest = max(rest, row["expires_at"])
    if kind in ("failed", "succeeded"):
        applied = bool(row["accepted"])
        if applied:
            token, until, rest = None, 0.0, row["expires_at"]
    elif kind == "claim":
        applied = rest <= now and until <= now
        if applied:
            token, until = row["token"], now + row["seconds"]
    elif token is not None and row["token"] == token:
        applied, token, until = True, None, 0.0
        if kind == "inconclusive":
            rest = max(rest, now + INCONCLUSIVE)
    return (token, until, rest), {"applied": applied, "lease_until": until, "retry_at": rest}


LEASE = T.StructType([T.StructField("applied", T.BooleanType()), T.StructField("lease_until", T.DoubleType()), T.StructField("retry_at", T.DoubleType())])


def leased(log: DataFrame, key: str = "engine", at: str = "at", id_col: str = "event_id", config: str | None = None, width: float = BUCKET) -> DataFrame:
    """`observed` over a log whose rows have a `kind` (failed, succeeded, claim, release, inconclusive), token and
    seconds, with `lease`: whether the row took effect, until when the engine is leased after it, and from when it
    may be tried. Other kinds take no effect."""
    failed = F.when(F.col("kind") == "failed", True).when(F.col("kind") == "succeeded", False)
    scan = _observed(log.withColumn("failed", failed), key, at, id_col, config, width)
    rows = scan.rows.withColumn("__stretch", F.struct("epoch", "__stretch")).drop("__bucket", "__island", "__n", "__first", "__expiry")
    return fold(rows, key, [at, id_col], lambda held, row: lease_step(held, row, at), "lease", LEASE, "__stretch").drop("__stretch", "failed")
