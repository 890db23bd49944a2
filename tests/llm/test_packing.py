import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from gleaner.llm import packing
from gleaner.llm.queries import tokenizer_files
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .util import docs


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_sequences(rows, capacity=1024):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_round_trip_and_odd_rows(spark, exact):
    rng = random.Random(1)
    texts = ["", None, "a", " \n\t", "naïve 😀 £", "<|endoftext|>", "x <|endoftext|> y", "the " * 1023, "the " * 1024, "w" * 5000, "é" * 3000, "1 " * 40_000]
    texts += [" ".join(rng.choices(["alpha", "Beta", "don't", "4.5", "été"], k=rng.randrange(1, 2500))) for _ in range(60)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    got = packing.pack_documents(docs(spark, rows).withColumn("length", F.lit("clash")), **tokenizer_files(), with_ids=True).collect()
    check_sequences(got)
    by = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by[r.doc_id].append(r)
    for i, x in rows:
        if i in (3, None):
            continue
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces[:-1])]))
        assert all(r.length == 1024 for r in pieces[1:])
        ids = [v for r in pieces for v in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*exact.encode(x or "", add_special_tokens=False).ids, 2]
    assert len(by[3]) == 3 and len(by[None]) == 1


def test_empty_table(spark):
    assert packing.pack_documents(docs(spark, []), **tokenizer_files()).count() == 0


def plain_best_fit(lengths, capacity=1024):
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in set(rooms) if r >= x]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.6, 1, 3000), 1, 1023).astype(np.int64) if seed else rng.integers(1, 1024, 3000)
    seq, off, n = packing.pack(lengths, 1024)
    assert n <= 1.01 * plain_best_fit(lengths) + 1
    assert sorted(zip(seq, off)) == sorted(set(zip(seq, off)))
    assert max(np.bincount(seq, weights=lengths)) <= 1024


@pytest.mark.parametrize("lengths", [[], [5], [1024 - 1] * 40, [600] * 31, [512] * 10, [1] * 2000, [342] * 9])
def test_pack_of_ties(lengths):
    seq, _, n = packing.pack(np.array(lengths, np.int64), 1024)
    per = 1024 // lengths[0] if lengths else 1
    assert n == -(-len(lengths) // per) == len(set(seq.tolist()))


def test_config_program_is_optimal_on_a_known_case():
    configs = packing.solve_configs(np.array([400, 600]), np.array([10.0, 10.0]), 1000)
    assert abs(sum(x for _, x in configs) - 10) < 1e-6
