import math
import random

import pytest
from gleaner.llm import topk
from pyspark.sql import functions as F


def plain(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for row, (i, v) in enumerate(good):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(good) if other != row and len(w) == len(v))[:k]
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(10_000, 8192), (40, 7), (300, 16)])
def test_matches_brute_force(spark, shard, block):
    rng = random.Random(shard)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, rng.gauss(0, 1))) for _ in range(6)]) for i in range(500)]
    rows += [(1000 + i, [0.25] * 6) for i in range(300)]
    rows += [(2000, [1.0, 2.0]), (2001, [3.0, -1.0]), (2020, []), (2021, []), (2040, None), (2060, [None] * 6), (2080, [math.inf] * 6), (2100, [math.nan] + [0.0] * 5), (None, [1.0] * 6), (40, [0.1] * 6), (40, [0.1] * 6), (None, None), (3000, [0.5] * 3000), (3001, [-0.25] * 3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit(1), "shard": F.lit(0)})
    exact = [(i, None if v is None else list(v)) for i, v in table.select("vec_id", "embedding").collect()]
    got = topk.search(table, F.col("vec_id") % 20 == 0, shard=shard, block=block)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain(exact, 20)


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(table, F.lit(True)).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(20 * i if i < 4 else 100 + i, [rng.choice((1, -1)) * rng.choice((2.0**k, 3.7, 1e7, 1e300)) for k in range(20, 24)]) for i in range(60)]
    rows += [(900, [2.0**50, 1.0, 1.0, 1.0]), (901, [2.0**50, 1.0, 1.0, 0.0]), (1000, [1e308, 0.0, 0.0, 0.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, shard=20).collect()
    want = plain([(i, v) for i, v in rows if i != 1000], 20)  # floats cannot scale that one
    top = {(r.query_id, r.vec_id): r.score for r in got}
    for i, _, j, s in want:
        assert top.get((i, j), s) == s
    assert len(got) == 20 * len({i for i, _ in rows if i % 20 == 0}) and top[1000, 900] == 2**63 - 1
    order = sorted((-int(v[0]), i) for i, v in rows if i != 1000)[:20]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1000] == [i for _, i in order]
