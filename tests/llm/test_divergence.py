import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from gleaner.llm import divergence
from pyspark.sql import functions as F

from .util import docs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    langs, groups = defaultdict(list), {}
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").translate(UPPER))
        langs[lang or ""].append(words)
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
    out = []
    for lang, texts in langs.items():
        df, total = Counter(t for w in texts for t in set(w)), Counter(t for w in texts for t in w)
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        share = lambda counts: {t: 1 + 1000000000 * (counts[t] + 1) // (sum(counts[k] for k in kept) + v) for t in kept}  # noqa: B023, E731
        q, p = share(total), {s: share(c) for (x, s), c in groups.items() if x == lang}
        f = lambda a, b: (a - b) * (a - b) // b
        for source in p:
            pairs = [(sum(f(p[source][t], p[other][t]) for t in kept), other) for other in p if other != source]
            words = [(f(p[source][t], q[t]), t) for t in kept if groups[lang, source][t] and p[source][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def got(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


def corpus(seed, sources, n=200):
    rng = random.Random(seed)
    some = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"] + ["Été", "été", "日本", "x1y"]
    return [(k, " ".join(rng.choices(some, [1 / (j + 1) for j in range(len(some))], k=rng.choice([0, 2, 40]))), rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}") for k in range(n)]


@pytest.mark.parametrize(
    "sources, settings",
    [(1, {}), (2, {}), (7, {}), (8, {"SLICE": 9}), (9, {"STATION": 2, "LEAST": 2}), (12, {"STATION": 1, "LEAST": 5, "LAP": 3, "SLICE": 20}), (5, {"HELD": 10, "LAP": 1})],
)
def test_equals_brute_force(spark, monkeypatch, sources, settings):
    for name, value in settings.items():
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(sources, sources)
    assert got(divergence.audit(docs(spark, rows), top=10)) == brute(rows, top=10)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "Only once", "en", "b"), (4, "x y", "fr", "a"), (4, "x y", "fr", "a"), (5, "x z", "fr", None), (6, "x " * 300_000, "fr", "c"), (None, "x é", "fr", "c")]
    clash = docs(spark, rows).withColumn("term", F.lit(1)).withColumn("count", F.lit(2)).withColumn("slice", F.lit(3)).withColumn("station", F.lit(4))
    assert got(divergence.audit(clash)) == brute(rows)
    assert divergence.audit(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", range(1, 14))
def test_every_station_meets_every_other_once(spark, n):
    peer, hosts = divergence.meetings("station", "stations", "turn")
    rows = spark.range(n).select(F.col("id").alias("station"), F.lit(n).cast("long").alias("stations"), F.explode(F.expr(f"sequence(0L, {n + n % 2 - 2}L)")).alias("turn")) if n > 1 else spark.range(0).select(F.col("id").alias("station"), F.col("id").alias("stations"), F.col("id").alias("turn"))
    rows = rows.select("station", "turn", peer.alias("peer"), hosts.alias("hosts")).filter(F.col("peer") < n).collect()
    assert sorted((r.station, r.peer) for r in rows) == [(a, b) for a in range(n) for b in range(n) if a != b]
    assert sorted((r.turn, r.station) for r in rows) == sorted({(r.turn, r.station) for r in rows})  # one meeting a round
    host = {(r.station, r.peer): r.hosts for r in rows}
    assert all(host[a, b] != host[b, a] for a, b in host)


def test_vectors_of_large_counts():
    a = (np.array([0, 3]), np.array([10**9, 1]), 5)
    b = (np.array([3, 4]), np.array([2, 10**9]), 1)
    p, q = [10**9, 5, 5, 1, 5], [1, 1, 1, 2, 10**9]
    f = lambda x, y: sum((m - n) ** 2 // n for m, n in zip(x, y))
    assert divergence.both_ways(a, b, 5) == (f(p, q), f(q, p))
    assert divergence._unpacked(divergence._packed(*b[:2]))[1].tolist() == [2, 10**9]
