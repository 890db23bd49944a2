import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from gleaner.llm import stock, stock_packing
from gleaner.llm.queries import QUERIES, tokenizer_files
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .util import docs


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, exact, capacity=1024):
    """Every id in exactly one piece, whose checksum is right; sequences gapless. Padding in tokens."""
    ids = {i: [*exact.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length > 0 and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    padding = 0
    for spans, whole in [(v, len(ids[i])) for i, v in by_doc.items()] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == whole if whole else at <= capacity
        if not whole and at & (at - 1):
            padding += capacity - at
    return padding


def test_odd_rows(spark, exact):
    rng = random.Random(3)
    texts = ["", None, "a", " \n\t", "naïve 😀 £", "<|endoftext|>", "the " * 1023, "the " * 1024, "w" * 5000, "é" * 3000, "1 " * 40_000]
    texts += [" ".join(rng.choices(["alpha", "Beta", "don't", "4.5", "été"], k=rng.randrange(1, 2500))) for _ in range(60)]
    texts += ["copy of one text " * 20] * 30
    rows = dict(enumerate(texts))
    clash = docs(spark, list(rows.items())).withColumn("length", F.lit("clash")).withColumn("task", F.lit(1)).withColumn("text_key", F.lit(1))
    assert check(stock_packing.pack(clash, **tokenizer_files()).collect(), rows, exact) == 0


def test_repeated_and_missing_ids(spark):
    rows = [(None, "no id"), (3, "again and again"), (3, "again and again"), (3, "other")]
    got = stock_packing.pack(docs(spark, rows), **tokenizer_files()).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 3 + 1 + 3 + 1 + 1 + 1
    assert sum(r.length for r in got if r.doc_id is None) == 3


def test_empty_table(spark):
    assert stock_packing.pack(docs(spark, []), **tokenizer_files()).count() == 0


def test_query(spark, exact):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert check(QUERIES["op13_stock_packing"](spark, "/root/testdata/sf0.001").collect(), texts, exact) == 0


def spread(lengths, capacity):
    """Pieces of each document of a plan."""
    counts = Counter(lengths)
    plan = stock.plan(dict(counts), capacity)
    places, out = stock.Places(plan), []
    for x, n in counts.items():
        sequence, at = places.of(np.full(n, x), np.arange(n))
        for s, a in zip(sequence.tolist(), at.tolist()):
            out.append([(x, s, a)] if s >= 0 else places.cuts(a, x))
    return plan, out


@pytest.mark.parametrize("seed", range(40))
def test_plans_fill_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = [16, 64, 1024][seed % 3]
    lengths = rng.integers(1, capacity, rng.integers(1, 60)).tolist() if seed % 2 else np.clip(rng.lognormal(3, 1, 900), 1, capacity - 1).astype(int).tolist()
    plan, pieces = spread(lengths, capacity)
    by = defaultdict(list)
    for parts in pieces:
        for n, s, o in parts:
            by[s].append((o, n))
    assert sorted(by) == list(range(plan.sequences))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity and not at & (at - 1)
    assert sum(n for parts in pieces for n, _, _ in parts) == sum(lengths)


def test_most_documents_stay_whole():
    rng = np.random.default_rng(5)
    _, pieces = spread(np.clip(rng.lognormal(5.6, 1, 20_000), 1, 1023).astype(int).tolist(), 1024)
    assert sum(len(parts) > 1 for parts in pieces) < 0.05 * len(pieces)


def test_program_is_optimal_on_a_known_case():
    got = stock.solve(np.array([400, 600]), np.array([10.0, 10.0]), 1000)
    assert abs(sum(x for _, x in got) - 10) < 1e-3
    got = stock.solve(np.array([3, 4, 5]), np.array([30.0, 30.0, 30.0]), 12)  # twelve is 3 + 4 + 5
    assert abs(sum(x for _, x in got) - 30) < 0.1
