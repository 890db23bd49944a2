"""Shared calls, inventories, digests, upserts and run checks against plain walks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import calls, evaluate, search
from gleaner.sources import captured, upserts


def requests(seed, n=300):
    rng, at, rows = random.Random(seed), 0.0, []
    for k in range(n):
        at += rng.choice([0.0, 0.0, 1.0, 7.0, 400.0])
        rows.append((k, f"k{rng.randrange(3)}", at, rng.choice([0.0, 3.0, 20.0, 900.0, None]), rng.choice([None, 0.0, 2.0, 30.0]), rng.random() < 0.7))
    rng.shuffle(rows)
    return rows


SCHEMA = "id int, key string, at double, seconds double, patience double, ok boolean"


@pytest.mark.parametrize("seed, width", [(0, 10.0), (1, 1000.0), (2, 1e9)])
def test_shared_calls(spark, seed, width):
    rows = requests(seed)
    got = {r.id: r.shared for r in calls.shared_calls(spark.createDataFrame(rows, SCHEMA), "key", "at", "id", "seconds", "patience", width).collect()}
    pending = {}
    for i, key, at, seconds, patience, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        call = pending.get(key)
        if call and (at >= call["end"] or all(w <= at for w in call["waiters"])):  # ended, or nobody waits
            call = None
        leader = call is None
        if leader:
            call = pending[key] = {"id": i, "end": at + (seconds or 0.0), "waiters": []}
        leaves = float("inf") if patience is None else at + patience
        call["waiters"].append(leaves)
        assert (got[i].leader, got[i].call, got[i].served, got[i].leaves_at) == (leader, call["id"], call["end"] <= leaves, min(call["end"], leaves))
    assert len(got) == len(rows)


@pytest.mark.parametrize("seed, width", [(3, 100.0), (4, 1e9)])
def test_inventory(spark, seed, width):
    rows = requests(seed)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("print", F.floor(F.col("at") / 5000))
    got = {r.id: r.inventory for r in calls.inventory_looks(frame, "key", "at", "id", "ok", width=width).collect()}
    held, prints, versions = {}, {}, []
    for i, key, at, _, _, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        looked = key not in held or at >= held[key][2]
        if looked:
            held[key] = (i, ok, at + (900 if ok else 60))
            if ok:
                versions.append((key, i, at // 5000, key in prints and prints[key] != at // 5000))
                prints[key] = at // 5000
        assert (got[i].looked, got[i].version, got[i].verified, got[i].refresh_after) == (looked, *held[key])
    found = calls.inventory_versions(frame, "key", "at", "id", "ok", "print", width)
    assert sorted((r.key, r.version, r.print, r.reset) for r in found.collect()) == sorted(versions)
    forced = calls.inventory_looks(frame.withColumn("force", F.lit(True)), "key", "at", "id", "ok", "force")
    assert forced.filter("NOT inventory.looked").count() == 0
    assert calls.inventory_looks(frame.filter("false"), "key", "at", "id", "ok").count() == 0


def test_digest_depends_on_rows_alone(spark):
    rows = [(k % 50, None if k % 7 == 0 else f"v{k}") for k in range(300)] + [(1, "same")] * 500
    frame = spark.createDataFrame(rows, "a int, b string")
    first = captured.digest_rows(frame, "a", "b").first()
    assert first.rows == 800
    assert captured.digest_rows(frame.repartition(7).orderBy(F.desc("b")), "a", "b").first() == first
    assert captured.digest_rows(frame.limit(799), "a", "b").first().digest != first.digest
    assert captured.digest_rows(frame.filter("false"), "a", "b").first() == (0, hashlib.sha256(b"").hexdigest())


def test_upserts(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "key string, stored_at double, payload string"
    put = lambda n, *rows: upserts.write_batch(spark.createDataFrame(list(rows), schema), n, path, "key", ["stored_at"])
    read = lambda: {r.key: r.payload for r in upserts.read_latest(spark, path, "key", ["stored_at"]).collect()}
    assert upserts.read_latest(spark, path, "key", ["stored_at"]) is None and upserts.compact(spark, path, "key", ["stored_at"]) is None
    put(0, ("a", 1.0, "a1"), ("b", 1.0, "b1"), ("a", 2.0, "a2"))
    put(1, ("b", 1.0, "b2"), ("c", 3.0, "c1"))
    assert read() == {"a": "a2", "b": "b2", "c": "c1"}  # of equal times the later batch
    put(1, ("b", 1.0, "b2"), ("c", 3.0, "c1"))
    put(0, ("a", 1.0, "a1"), ("b", 1.0, "b1"), ("a", 2.0, "a2"))
    assert read() == {"a": "a2", "b": "b2", "c": "c1"}  # sent again
    (tmp_path / "table" / "_died").mkdir()
    (tmp_path / "table" / "_died" / "part-0.parquet").write_bytes(b"half a file")
    assert read() == {"a": "a2", "b": "b2", "c": "c1"}  # a writer that was killed
    early = upserts.read_latest(spark, path, "key", ["stored_at"])
    assert upserts.compact(spark, path, "key", ["stored_at"]) == 1
    assert {r.key for r in early.collect()} == {"a", "b", "c"}  # who had begun to read reads on
    put(1, ("a", 9.0, "late"))  # a batch that the base holds
    put(2, ("a", 0.5, "old"), ("c", 4.0, "c2"))
    assert read() == {"a": "a2", "b": "b2", "c": "c2"}
    upserts.vacuum(spark, path)
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["base=1", "batch=2"] and read()["c"] == "c2"


def test_upserts_of_a_stream(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    schema = "key string, stored_at double, payload string"
    for k in range(3):
        spark.createDataFrame([("a", float(k), f"v{k}"), (f"k{k}", 0.0, "x")], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        upserts.upsert_stream(stream, path, str(tmp_path / "check"), "key", ["stored_at"]).awaitTermination()
    got = upserts.read_latest(spark, path, "key", ["stored_at"]).collect()
    assert sorted((r.key, r.payload) for r in got) == [("a", "v2"), ("k0", "x"), ("k1", "x"), ("k2", "x")]


def test_citations_of_any_length(spark):
    rng = random.Random(4)
    passages = [(k, " ".join(rng.choices(["Alpha", "be", "c", "delta\n"], k=rng.randrange(0, 40)))) for k in range(60)] + [(60, None), (61, "")]
    quotes = [(k, p[1][:n]) for k, (p, n) in enumerate(zip(passages[:40], range(40)))] + [(90, "a"), (91, " "), (92, None), (93, "c"), (94, "c")]
    plain = lambda x: " ".join((x or "").split()).lower()
    want = sorted((q, p) for q, x in quotes for p, y in passages if plain(x) and plain(x) in plain(y))
    q, p = spark.createDataFrame(quotes, "q int, quote string"), spark.createDataFrame(passages, "p int, passage string")
    for chars in (1, 50, 4_000_000):
        assert sorted(map(tuple, evaluate.citation_match(q, p, "q", "quote", "p", "passage", chars).collect())) == want
    assert evaluate.citation_match(q.filter("false"), p, "q", "quote", "p", "passage").collect() == []


def test_types_of_engines_and_scores(spark):
    items = [
        {"url": "http://a.example/", "engines": "one", "score": "1.5"}, {"url": "http://b.example/", "engines": ["x", 5, None, True], "score": 2},
        {"url": "http://c.example/", "engines": [], "engine": "z", "score": None}, {"url": "http://d.example/", "engines": {"a": 1}, "engine": "q"}, {"url": "http://[bad"},
        {"url": "http://e.example:99999/"}, {"url": "http://f.example/", "engines": 0, "engine": "k", "score": "odd"},
    ]
    got = search.parse_results(spark.createDataFrame([(1, json.dumps({"results": items}))], "k int, b string"), "k", "b").collect()
    assert [(r.rank, r.engines, r.score) for r in got] == [(1, ["one"], 1.5), (2, ["x", "5", "None", "True"], 2.0), (3, ["z"], 0.0), (4, [], 0.0), (7, ["k"], 0.0)]


def test_run_checks(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases = frame([("good",), ("missing",), ("uncited",), ("bare",)], "run string")
    expected = frame([("good", "f", "A  b"), ("good", "g", None), ("missing", "f", "x"), ("uncited", "f", "x")], "run string, field string, value string")
    reported = frame([("good", "f", "a B"), ("good", "g", None), ("good", "extra", "z"), ("uncited", "f", "x")], "run string, field string, value string")
    evidence = frame([("good", "f", "u", "the  Quote"), ("uncited", "f", "u", "not there"), ("uncited", "other", "u", "")], "run string, field string, url string, quote string")
    reads = frame([("good", "u", "before THE quote after"), ("uncited", "u", "something else"), ("uncited", "v", "not there")], "run string, url string, content string")
    got = {r.run: (r.passed, r.failed) for r in evaluate.passed(evaluate.run_checks(cases, "run", expected, reported, evidence, reads), "run").collect()}
    assert got == {
        "good": (True, []), "missing": (False, ["f:value", "required_finding_keys"]),
        "uncited": (False, ["all_cited_passages_returned", "f:evidence"]), "bare": (True, []),
    }
