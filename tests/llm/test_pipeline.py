import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from gleaner.llm import simhash
from pyspark.sql import functions as F

from .util import docs


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(x, y):
    x, y = shingles(x), shingles(y)
    return len(x & y) / len(x | y)


def corpus(seed=6, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randrange(150, 400)))))
    return rows


def groups(rows):
    """The first row of the group of each distinct row (id, text); null ids come last."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, (_, x)), (j, (_, y)) in combinations(enumerate(rows), 2):
        if jaccard(x, y) >= 0.8:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {r: rows[root(k)] for k, r in enumerate(rows)}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "one two three"), (903, "One two  THREE"), (904, "one two four"), (None, "one two three"), (902, "one two three"), (None, "alone")]
    got = sorted(((r.id, r.keeper) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=repr)
    assert got == sorted(((r[0], k[0]) for r, k in groups([(i, x or "") for i, x in rows]).items() if r != k), key=repr)


def test_rows_are_judged_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, "only this"), (None, "only this")]
    out = simhash.without_near_duplicates(docs(spark, rows).withColumnsRenamed({"n_chars": "near_id"}))
    assert out.columns == ["doc_id", "text", "lang", "source", "near_id"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, a), (2, b), (3, c), (None, "only this")], key=repr)


def test_cells_of_a_hot_bucket(spark, monkeypatch):
    rows = corpus(9, 80)
    monkeypatch.setattr(simhash, "PAIR_CELL", 4)
    monkeypatch.setattr(simhash, "ROUNDS", (1, None))
    got = {r.id: r.keeper for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {r[0]: k[0] for r, k in groups(rows).items() if r != k}


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = str(tmp_path)
    odd = docs(spark, [(5000, None), (5001, ""), (5002, "123 456"), (None, "The of and then the one.", None, None), (5003, "The of and then the two. " * 4000, None, "src0")])
    table = table.select(*odd.columns).union(odd)
    table.write.parquet(f"{d}/documents.parquet")
    before = table
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, d)
        if name != "sequences":
            assert after.columns == table.columns
        path = f"{d}/{name}.parquet"
        after.write.parquet(path)
        after = spark.read.parquet(path)
        if name == "language":
            assert {r.doc_id for r in table.collect()} - {r.doc_id for r in after.collect()} == {5000, 5001, 5002}
            assert after.filter("lang is null").count() == 0
        if name == "lines":
            assert after.count() == before.count() and after.filter(F.col("n_chars") != F.length("text")).count() == 0
        before = after
    assert corpus_pipeline.run(spark, d).count() == before.count() > 0


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_of_one_text_that_are_unlike_each_other(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**9)}" for _ in range(404)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(5, 395, 10), 8):
            w[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    assert all(jaccard(rows[0][1], x) >= 0.8 for _, x in rows) and jaccard(rows[1][1], rows[2][1]) < 0.8
    got = {r.id: r.keeper for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: 0 for i, _ in rows if i}


def test_pairs_at_the_least_likeness_are_candidates():
    rng = np.random.default_rng(8)
    for n, other in ((8, 10), (40, 50), (120, 150), (320, 400), (2000, 2500)):
        for _ in range(300):
            y = rng.integers(0, 2**64, other, dtype=np.uint64)
            x = y[:n]
            assert (simhash.band_keys(x) == simhash.band_keys(y)).any()
            apart = [(simhash.majority(simhash.remixed(x, j)) ^ simhash.majority(simhash.remixed(y, j))).bit_count() for j in range(3)]
            assert sum(apart) <= 3 * simhash.FAR
            a, b = (np.frombuffer(simhash.sketch(z), np.uint8)[None, :] for z in (x, y))
            assert simhash.estimated(a, b)[0] >= 0.8 - simhash.MARGIN


def test_planes_of_several_words():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, (300, 3), dtype=np.uint64)
    fps[150:] = fps[:150] ^ (np.uint64(1) << rng.integers(0, 64, (150, 3), dtype=np.uint64))
    row, col = simhash.near(fps, simhash.planes_of(fps), 300, 70)
    d = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2)
    assert set(zip(row.tolist(), col.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= 70))))
