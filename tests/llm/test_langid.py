import random
import zlib

import numpy as np
import pytest
from gleaner.llm import langid
from pyspark.sql import functions as F

from .util import docs

SYLLABLES = {"aa": "ko mi ra tu", "bb": "sch zen ung ber", "cc": "eau oi que lle"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        word = lambda: "".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4)))  # noqa: E731, B023
        out.append((i, " ".join(word() for _ in range(rng.choice((3, 20, 300)))), lang if i % 7 else None, "s"))
    return out


def test_held_out_accuracy_and_odd_rows(spark, rows):
    odd = [(1000, None, "aa", None), (1001, "", "bb", None), (1002, "123 -- 😀", "cc", None), (None, "kokomi", None, None), (1003, "ko" * 100_000, None, None), (1004, "KOMI Ratu ko", None, None)]
    table = docs(spark, rows + odd).withColumns({"score": F.lit("x"), "a.b": F.lit(1)})
    model = langid.train(table, ~langid.held_out())
    got = langid.identify(table.withColumn("held", langid.held_out()), model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all((r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, None, 1003, 1004)] == ["und", "und", "und", "aa", "aa", "aa"]
    held = [by[r[0]].lang_pred == r[2] for r in rows if r[2] and by[r[0]].held]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, "text", None, None)], [(1, None, "aa", None)]):
        table = docs(spark, rows)
        got = langid.identify(table, langid.train(table, F.lit(True))).collect()
        assert all((r.lang_pred, r.score) in {("und", 0.0), ("aa", 1.0)} for r in got)


def test_one_class_and_penalty():
    one = langid.fit([("abc", "x")] * 3, np.ones(langid.BUCKETS))
    assert one.predict("abc") == ("x", 1.0)
    rows = [("aaa bbb", "x"), ("ccc ddd", "y")] * 40
    loose, tight = (langid.fit(rows, np.ones(langid.BUCKETS), l1=v) for v in (0.0, 2.0))
    assert np.count_nonzero(tight.weights) < np.count_nonzero(loose.weights)
    assert loose.predict("bbb")[0] == "x" and loose.predict("ddd")[0] == "y"


def test_fit_matches_a_plain_leader():
    """The weights against follow-the-regularised-leader written coordinate by coordinate."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(SYLLABLES[c].split()) for _ in range(6)), c) for c in rng.choices(list(SYLLABLES), k=24)]
    model = langid.fit(rows, np.ones(langid.BUCKETS), alpha=0.5, beta=1.0, l1=0.02, l2=0.1, epochs=2, seed=7)
    classes = sorted(SYLLABLES)
    order = np.random.default_rng(7).permutation(len(rows))
    used = order[len(order) // 4 :]
    z, n = {}, {}

    def weight(key):
        a, b = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - np.sign(a) * 0.02) / ((1.0 + b**0.5) / 0.5 + 0.1)

    for _ in range(2):
        for k in used:
            at, x = model.features(rows[k][0])
            parts = [*zip(at.tolist(), x.tolist()), ("bias", 1.0)]
            score = np.array([sum(v * weight((f, c)) for f, v in parts) for c in range(3)])
            p = np.exp(score - score.max())
            p /= p.sum()
            for c in range(3):
                for f, v in parts:
                    g = v * (p[c] - (classes[c] == rows[k][1]))
                    sigma = ((n.get((f, c), 0.0) + g * g) ** 0.5 - n.get((f, c), 0.0) ** 0.5) / 0.5
                    new = z.get((f, c), 0.0) + g - sigma * weight((f, c))
                    n[f, c] = n.get((f, c), 0.0) + g * g
                    z[f, c] = new
    for c in range(3):
        assert model.bias[c] == pytest.approx(weight(("bias", c)), abs=1e-9)
        for f in {f for f, d in z if d == c and f != "bias"}:
            assert model.weights[f, c] == pytest.approx(weight((f, c)), abs=1e-9)
