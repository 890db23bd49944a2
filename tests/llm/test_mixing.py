import random
from collections import defaultdict

import pytest
from gleaner.llm import mixing
from pyspark.sql import functions as F

from .util import docs


def corpus(n=3000):
    rng = random.Random(2)
    out = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(4)}"
        lang = rng.choice(["en", "en", "en", "fr", None])
        out.append((i, "word " * rng.randrange(1, 40) + rng.choice(["", " | x", "!! y", "### "]), lang, source if i % 50 else None))
    return out


def test_marginals_reach_their_targets(spark):
    targets = {"source": {"hot": 0.2, "s0": 0.2, "s1": 0.2, "s2": 0.15, "s3": 0.15, mixing.NONE: 0.1}, "lang": {"en": 0.5, "fr": 0.3, mixing.NONE: 0.2}}
    got = mixing.mix(docs(spark, corpus()), targets, budget=0.1, rounds=20).collect()
    total = sum(r.mix_tokens for r in got)
    expected = defaultdict(float)
    for r in got:
        assert 0 <= r.mix_chance <= 1
        for key in (("source", r.source), ("lang", r.lang)):
            expected[key] += r.mix_chance * r.mix_tokens
    capped = any(r.mix_chance == 1 for r in got)
    for d, shares in targets.items():
        for value, share in shares.items():
            have = expected[d, None if value == mixing.NONE else value] / (0.1 * total)
            assert capped or have == pytest.approx(share, rel=1e-3)
    assert sum(r.mix_chance * r.mix_tokens for r in got) == pytest.approx(0.1 * total, rel=1e-6)
    assert sum(r.mix_tokens for r in got if r.mix_kept) == pytest.approx(0.1 * total, rel=0.2)


@pytest.mark.parametrize("budget", [0.9, 1.0, 2.0])
def test_chances_never_exceed_one(spark, budget):
    got = mixing.mix(docs(spark, corpus(400)), budget=budget).collect()
    assert all(0 < r.mix_chance <= 1 for r in got) and sum(r.mix_chance * r.mix_tokens for r in got) == pytest.approx(min(1, budget) * sum(r.mix_tokens for r in got), rel=1e-6)


def test_odd_rows(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    rows = [(1, None), (2, "", "en", "a"), (None, "x y", None, "a"), (3, "w " * 200_000, "en", "b"), (3, "again", "en", "b")]
    table = docs(spark, rows).withColumns({"Mix_Kept": F.lit(1), "tokens": F.lit(2), "w": F.lit(3), "__source": F.lit(4), "a.b": F.lit(5)})
    out = mixing.mix(table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "w", "__source", "a.b", "mix_topic", "mix_tokens", "mix_weight", "mix_chance", "mix_kept"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert len(got) == 5 and got[1, None].mix_tokens == got[2, ""].mix_tokens == 0 and got[3, "w " * 200_000].mix_tokens == 200_000


def test_one_task_and_shuffled_raking_agree(spark):
    cells = spark.createDataFrame([(f"s{i % 7}", f"l{i % 3}", f"t{i % 2}", 10 + i * i) for i in range(42)], "source string, lang string, topic string, tokens long")
    rows = [sorted((r.source, r.lang, r.topic, round(r.weight, 9), round(r.chance, 9)) for r in mixing.chances(c).collect()) for c in (cells.coalesce(1), cells.repartition(8))]
    assert rows[0] == rows[1]


def plain_rake(cells, goals, rounds):
    w = {c: float(t) for c, t in cells.items()}
    for _ in range(rounds):
        for at in range(3):
            total = defaultdict(float)
            for c, x in w.items():
                total[c[at]] += x
            w = {c: x * goals[at][c[at]] / total[c[at]] for c, x in w.items()}
    return w


def test_raking_matches_a_plain_one(spark, monkeypatch):
    rng = random.Random(4)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): rng.randrange(1, 5000) for i in range(5) for j in range(3) for k in range(4)}
    goals = []
    for at in range(3):
        own = defaultdict(float)
        for c, t in cells.items():
            own[c[at]] += t
        own = {v: t**mixing.TEMPER for v, t in own.items()}
        goals.append({v: t / sum(own.values()) for v, t in own.items()})
    want = plain_rake(cells, goals, 60)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-12)
    monkeypatch.setattr(mixing.rake, "__defaults__", (40, 1e-12))
    got = mixing.chances(spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long"), budget=0.3).collect()
    assert {(r.source, r.lang, r.topic): r.weight for r in got} == {c: pytest.approx(x, rel=1e-6) for c, x in want.items()}
    assert sum(r.chance * r.tokens for r in got) == pytest.approx(0.3 * sum(cells.values()))


def test_a_topic_column_is_used(spark):
    table = docs(spark, [(i, "some words here", "en", "a") for i in range(6)]).withColumn("topic", F.when(F.col("doc_id") < 3, "x"))
    assert {r.doc_id: r.mix_topic for r in mixing.mix(table).collect()} == {i: "x" if i < 3 else mixing.NONE for i in range(6)}


def test_contradicting_targets_warn(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="contradict"):
        mixing.chances(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, rounds=4).collect()
