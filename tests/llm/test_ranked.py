import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from gleaner.llm import ranked
from gleaner.llm.terms import LETTERS_DIGITS, Words
from pyspark.sql import functions as F

from .util import docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(rows, items, k=50):
    """Scores by the plain formula: rows of (item, rank, doc_id, score), a list an item row."""
    counted = [(i, c) for i, x in rows if (c := Counter(terms(x)))]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, c) in enumerate(counted):
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, at, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(frame):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in frame.collect()), key=repr)


def corpus(seed, n=300, words=60):
    rng = random.Random(seed)
    some = [f"w{k}" for k in range(words)] + ["Été", "ÉTÉ", "日本", "x1"]
    weights = [1 / (k + 1) for k in range(len(some))]
    texts = [rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(some, weights, k=rng.choice([0, 1, 3, 30, 200]))) for _ in range(n)]
    texts[5:40] = [texts[4]] * 35  # copies tie
    return [(k, x) for k, x in enumerate(texts)] + [(n, None), (n + 1, "?!")]


@pytest.mark.parametrize("seed, shard, block", [(0, 1 << 20, 1 << 18), (1, 400, 30), (2, 60, 1 << 18)])
def test_equals_brute_force(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "BLOCK", block)
    rows = corpus(seed)
    asked = [(k, x) for k, x in enumerate(["w0 w1 W2", "w5", "été x1 日本", "nothing here", "", None, "w0 w0 w0 " * 50, " ".join(f"w{k}" for k in range(60))])]
    got = ranked.search(docs(spark, rows), items(spark, asked), k=20)
    assert found(got) == sorted(brute(rows, asked, 20), key=repr)


def test_odd_rows(spark):
    rows = [(1, "apple pie"), (1, "apple pie"), (None, "apple pie"), (0, "apple " * 200_000), (7, None), (8, "")]
    asked = [(1, "Apple"), (1, "Apple"), (None, "pie")]
    clash = docs(spark, rows).withColumn("key", F.lit("x")).withColumn("terms", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("n", F.lit(3))
    got = ranked.search(clash, items(spark, asked).withColumn("score", F.lit(0)).withColumn("floor", F.lit(9)))
    assert found(got) == sorted(brute(rows, asked), key=repr)


def test_empty_tables(spark):
    some, none = docs(spark, [(1, "a b")]), docs(spark, [])
    assert ranked.search(none, items(spark, [(1, "a")])).count() == 0
    assert ranked.search(some, items(spark, [])).count() == 0
    assert ranked.search(docs(spark, [(1, None)]), items(spark, [(1, None)])).count() == 0


def test_filter_keeps_every_word(spark):
    words = [f"wörd{k}" for k in range(3000)]
    bits = ranked.word_filter(spark.createDataFrame([(w,) for w in words], "term string"))
    ats = [__import__("zlib").crc32(w.encode()) & (ranked.FILTER_BITS - 1) for w in words]
    assert all(bits[a >> 3] >> (a & 7) & 1 for a in ats) and len(bits) * 8 == ranked.FILTER_BITS
    assert sum(bin(b).count("1") for b in bits) == len(set(ats))


def test_search_stops_early():
    rng = np.random.default_rng(1)
    n, words = 5000, 6
    doc, word = np.repeat(np.arange(n), words), np.tile(np.arange(words), n)
    impact = (1000 * rng.pareto(1.2, n * words)).astype(np.int64) + 1
    held = ranked.Postings(doc, word, impact)
    some, score, read = held.search(np.arange(words), 10, 0)
    total = np.bincount(doc, weights=impact).astype(np.int64)
    assert sorted(score.tolist())[-10:] == np.sort(total)[-10:].tolist() and set(np.argsort(-total)[:9]) <= set(some.tolist())
    assert read < 0.2 * len(doc)
    _, score, less = held.search(np.arange(words), 10, int(np.sort(total)[-10]))  # a floor from elsewhere
    assert sorted(score.tolist())[-10:] == np.sort(total)[-10:].tolist() and less <= read


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
def test_windows_cut_no_word(window):
    rng = random.Random(window)
    text = "".join(rng.choices(["a", "Zz", "é", "日", " ", "\n", "9", "-", "word"], k=2000))
    assert [w.decode() for part in Words(LETTERS_DIGITS, window).lists(text.encode()) for w in part] == terms(text)
    assert list(Words(LETTERS_DIGITS).lists(None)) == []
