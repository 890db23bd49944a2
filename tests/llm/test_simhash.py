import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from gleaner.llm import simhash
from gleaner.llm.components import components

from .util import docs


def plain_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            up[root(b)] = root(a)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return sorted(((i, f, ids.get(root(k))) for k, ((i, _), f) in enumerate(zip(rows, fps))), key=repr)


def got_components(spark, rows, **more):
    got = simhash.simhash_components(docs(spark, rows), **more).collect()
    return sorted(((r.id, r.fp % 2**64, r.component_id) for r in got), key=repr)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            w[rng.randrange(len(w))] = "edit"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice((1, 3, 80, 400))))))
    return rows


def test_components_match_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \t\x0b"), (None, "w1"), (None, "alone here"), (903, "ALONE  here"), (5, "x y z"), (5, "x y z"), (904, "a b " * 30_000)]
    assert got_components(spark, rows) == plain_components(rows)


def test_empty_table(spark):
    assert got_components(spark, []) == []


@pytest.mark.parametrize("radius", [0, 3, 4, 11, 63])
def test_near_is_exact(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64, 700, dtype=np.uint64)
    fps[350:] = fps[:350] ^ (np.uint64(1) << rng.integers(0, 64, 350, dtype=np.uint64))
    row, col = simhash.near(fps, simhash.planes_of(fps), 700, radius)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    assert set(zip(row.tolist(), col.tolist())) == set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_each_link_agrees_on_a_table(n):
    tables = [sum(1 << b for b in bits) for bits in simhash.tables_for(n, 4)]
    rng = random.Random(n)
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not diff & m for m in tables)


def test_hot_buckets_split_into_cells(spark):
    rng = np.random.default_rng(0)
    fps = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = components(simhash.links(table, 4, cell=32))
    label = {r.node: r.label for r in got.collect()}
    whole = components(simhash.links(table, 4))
    assert label == {r.node: r.label for r in whole.collect()}
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for a, b in zip(*np.nonzero(np.triu(d, 1))):
        assert label[int(fps[a : a + 1].view(np.int64)[0])] == label[int(fps[b : b + 1].view(np.int64)[0])]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 200)] + [(5, 3), (3, 4), (9, 9)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{k: 100 for k in range(100, 201)}, 3: 3, 4: 3, 5: 3}


def test_few_edges_run_in_few_tasks(spark):
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = components(spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (5, 5)], "a long, b long"))
        assert got.rdd.getNumPartitions() <= 4  # 80 before: a task a shuffle partition and side
        assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_of_a_cell_are_made_once(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.95)], "a long, b long, like double").mapInArrow(lambda b: b, "a long, b long, like double")
    got = simhash._likest(pairs, 1, "like")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 3)]
