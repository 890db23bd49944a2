"""Observations, leases and configurations against a plain walk over each engine's log."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import availability, health
from gleaner.streaming import state

WAITS = {"captcha": 86400, "Suspended: captcha": 86400, "timeout": 120, "proxy down": 120, "odd": 300, None: 300}
SCHEMA = "event_id int, engine string, at double, kind string, reason string, retry_after double, started_at double, token string, seconds double, config string"


def walk(rows, configured=True):
    """The state after each row, as a process that sees them one by one keeps it."""
    out, states = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        s = states.get(r["engine"])
        if s is None or (configured and s["config"] != r["config"]):
            s = states[r["engine"]] = {"config": r["config"], "n": 0, "ok": 0, "expires": 0.0, "failure": 0.0, "until": 0.0, "token": None}
        now, applied, delay = r["at"], False, None
        if r["kind"] == "failed":
            reason = r["reason"] or ""
            s["n"] = max(1, s["n"]) if "suspended" in reason.lower() else s["n"] + 1
            base, local = WAITS[r["reason"]], "proxy" in reason
            top = 1800 if local else max(base, 604800)
            if not local and "captcha" not in reason and not s["ok"]:
                top = min(top, 3600)
            delay = max(min(base * 2 ** min(s["n"] - 1, 8), top), r["retry_after"] or 0)
            s.update(expires=max(s["expires"], now + delay), failure=now, until=0.0, token=None)
            applied = True
        elif r["kind"] == "succeeded":
            if r["started_at"] is None or s["failure"] <= r["started_at"]:
                s.update(n=0, ok=s["ok"] + 1, expires=0.0, until=0.0, token=None)
                applied = True
        elif r["kind"] == "claim":
            if s["expires"] <= now and s["until"] <= now:
                s.update(until=now + r["seconds"], token=r["token"])
                applied = True
        elif s["token"] is not None and s["token"] == r["token"]:
            s.update(until=0.0, token=None)
            applied = True
            if r["kind"] == "inconclusive":
                s["expires"] = max(s["expires"], now + 120)
        out[r["event_id"]] = (applied, s["n"], delay, s["expires"], s["until"])
    return out


def logs(seed, n=400, engines=3, step=60):
    rng, at, rows = random.Random(seed), 10_000.0, []
    for k in range(n):
        at += rng.choice([0, 1, step, 200, 5000])
        kind = rng.choices(["failed", "succeeded", "claim", "release", "inconclusive"], [2, 1, 4, 2, 2])[0]
        started = at - rng.choice([0, 100, 4000]) if rng.random() < 0.5 else None
        rows.append(dict(event_id=k, engine=f"e{rng.randrange(engines)}", at=at, kind=kind, reason=rng.choice(list(WAITS)) if kind == "failed" else None, retry_after=rng.choice([None, 50.0, 9999.0]), started_at=started, token=f"t{rng.randrange(3)}", seconds=rng.choice([30.0, 3000.0]), config=rng.choices(["a", "b", None], [30, 1, 1])[0]))
    return rows


@pytest.mark.parametrize("seed, width", [(0, 100.0), (1, 3000.0), (2, 1e9), (3, 20000.0)])
def test_leases_equal_a_walk(spark, seed, width):
    rows = logs(seed)
    random.Random(seed).shuffle(rows)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = availability.leased(frame, config="config", width=width).collect()
    want = walk(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.lease.applied, r.consecutive_failures, r.delay_seconds, r.lease.retry_at, r.lease.lease_until) == want[r.event_id], r


def test_hot_key_equals_windows(spark):
    rows = [r | {"engine": "hot", "started_at": None} for r in logs(7, 600) if r["kind"] in ("failed", "succeeded")]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumn("failed", F.col("kind") == "failed")
    columns = ["event_id", "consecutive_failures", "suspension_report", "delay_seconds", "expires_at"]
    got = availability.observed(frame, width=5000.0)
    assert sorted(got.select(columns).collect()) == sorted(health.transitions(frame).select(columns).collect())


def test_leases_end_early_hold_and_wait(spark):
    row = lambda i, at, kind, token=None, reason=None: dict(event_id=i, engine="e", at=at, kind=kind, reason=reason, retry_after=None, started_at=None, token=token, seconds=1000.0, config="a")
    rows = [
        row(0, 0.0, "claim", "t"), row(1, 10.0, "claim", "u"), row(2, 20.0, "release", "t"), row(3, 21.0, "claim", "u"),  # released early: the next is granted
        row(4, 30.0, "inconclusive", "u"), row(5, 149.0, "claim", "v"), row(6, 150.0, "claim", "v"),  # rests for 120 seconds
        row(7, 200.0, "failed", reason="timeout"), row(8, 210.0, "release", "v"), row(9, 319.0, "claim", "w"), row(10, 320.0, "claim", "w"),  # the failure voids the lease and cools
    ]
    got = availability.leased(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), width=50.0).orderBy("event_id").collect()
    assert [r.lease.applied for r in got] == [True, False, True, True, True, False, True, True, False, False, True]


def test_empty_and_null_keys(spark):
    assert availability.leased(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [tuple((r | {"engine": None}).values()) for r in logs(5, 40)]
    assert availability.leased(spark.createDataFrame(rows, SCHEMA), config="config").count() == 40


def test_stream_equals_a_walk(spark, tmp_path):
    rows = sorted(logs(11, 300), key=lambda r: (r["at"], r["event_id"]))
    source = str(tmp_path / "in")
    for k in range(3):  # three micro-batches, each in any order
        part = [tuple(r.values()) for r in rows[k * 100 : k * 100 + 100]]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = state.availability_stream(spark.readStream.schema(SCHEMA).parquet(source))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = walk(rows)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(rows)
    for r in got:
        applied, count, _, retry, until = want[r.event_id]
        assert (r.applied, r.consecutive_failures, r.retry_at, r.lease_until) == (applied, count, retry, until), r


def test_claims_stream_takes_the_last_moment_and_empty_answers(spark, tmp_path):
    rows = [("k", k, float(t), k % 3 > 0) for k, t in enumerate([0, 5, 10, 20, 21, 31, 41])]
    frame = spark.createDataFrame(rows, "key string, id int, at double, full boolean")
    frame.write.parquet(str(tmp_path / "in"))
    for name, more in (("plain", {}), ("last", {"inclusive": True}), ("kept", {"stored": "full", "inclusive": True})):
        stream = state.claims_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "key", "at", 10.0, "id", **more)
        stream.writeStream.format("memory").queryName(f"claims_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        want = health.claims(frame, "key", "at", 10.0, "id", **more).orderBy("id").collect()
        assert [r.granted for r in spark.table(f"claims_{name}").orderBy("id").collect()] == [r.granted for r in want]
