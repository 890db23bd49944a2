import random
from collections import defaultdict

import numpy as np
import pytest
from gleaner.llm import passages
from pyspark.sql import functions as F

from .util import docs


def run(spark, rows, **more):
    got = defaultdict(list)
    for r in passages.shared_passages(docs(spark, rows).withColumns({"doc": F.lit(1), "start": F.lit(2), "label": F.lit(3)}), **more).collect():
        got[r.doc_id].append((r.start_word, r.end_word, r.class_id))
    return {k: sorted(v) for k, v in got.items()}


def planted(seed=4):
    """120 documents of own words; fuzzy copies of three passages in some; who holds what, from where to where."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [[word() for _ in range(n)] for n in (55, 120, 300)]
    rows, truth = [], {}
    for i in range(120):
        own = [word() for _ in range(rng.randrange(20, 400))]
        if i % 3 == 0:
            k = rng.randrange(3)
            p = list(base[k])
            if i > 20:
                for _ in range(len(p) // 25):
                    at, what = rng.randrange(5, len(p) - 5), rng.randrange(3)
                    p[at : at + 1] = [[word()], [], [p[at], word()]][what]
            at = rng.randrange(len(own))
            own[at:at] = p
            truth[i] = (k, at, at + len(p))
        rows.append((i, " ".join(own)))
    return rows, truth


def test_finds_planted_fuzzy_passages_and_nothing_else(spark):
    rows, truth = planted()
    got = run(spark, rows)
    assert set(got) == set(truth)
    kinds = defaultdict(set)
    for i, (k, a, b) in truth.items():
        (s, e, label), = got[i]
        assert min(e, b) - max(s, a) >= 0.8 * (b - a) and a - s <= 12 and e - b <= 12  # edits near an end may cut it off
        kinds[k].add(label)
    assert all(len(v) == 1 for v in kinds.values()) and len({min(v) for v in kinds.values()}) == 3


def test_odd_rows_and_copies(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    a, p = text(70), text(60)
    once = f"{p} {text(9)} {p}"
    rows = [(1, a), (2, a), (3, a.upper() + "!"), (4, None), (5, ""), (6, "short"), (7, "short"), (8, once), (9, p + " " + text(5)), (9, "zz other"), (None, a), (10, text(30_000) + " " + a), (11, " ".join(["same"] * 500)), (12, " ".join(["same"] * 400))]
    got = run(spark, rows)
    assert got[1] == got[2] == got[3] == [(0, 70, 1)]
    (s, e, label), = got[10]
    assert abs(s - 30_000) <= 2 and e == 30_070 and label == 1
    assert not {4, 5, 6, 7, None} & set(got)
    assert 8 in got and 9 in got
    assert run(spark, []) == {}


def test_every_exact_run_of_fifty_words_is_found(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = defaultdict(list)
    for r in passages.shared_passages(table).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
    holds = defaultdict(set)
    words = {r.doc_id: passages.word_hashes(r.text.encode()).tolist() for r in table.collect()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            holds[tuple(w[k : k + 50])].add((i, k))
    shared = [x for v in holds.values() if len({i for i, _ in v}) > 1 for x in v]
    assert shared
    missed = [(i, k) for i, k in shared if not any(s <= k + 5 and e >= k + 45 for s, e in got[i])]
    assert len(missed) <= 0.02 * len(shared)


def plain_chain(parts):
    best = [0.0] * len(parts)
    for m in sorted(range(len(parts)), key=lambda m: parts[m]):
        x, y, n = parts[m]
        best[m] = n + max([0.0] + [best[p] - passages.GAP_COST * (x - px - pn + y - py - pn) for p, (px, py, pn) in enumerate(parts) if px + pn <= x and py + pn <= y])
    return max(best)


@pytest.mark.parametrize("seed", range(20))
def test_best_chain_is_optimal(seed):
    rng = random.Random(seed)
    parts = sorted({(rng.randrange(60), rng.randrange(60), rng.choice((8, 9, 15))) for _ in range(30)})
    best = passages.chains(parts)[0]
    score = sum(n for _, _, n in best) - sum(passages.GAP_COST * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2]) for a, b in zip(best, best[1:]))
    assert score == pytest.approx(plain_chain(parts))


@pytest.mark.parametrize("n", [8, 9, 19, 20, 500])
def test_seeds_leave_no_window_empty(n):
    words = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    _, at = passages.seeds(words)
    ends = [-1, *at.tolist(), n - passages.K + 1]
    assert max(b - a for a, b in zip(ends, ends[1:])) <= passages.WINDOW


@pytest.mark.parametrize("cell", [1, 1024])
def test_passages_whose_seeds_others_hold_first(spark, monkeypatch, cell):
    """every seed of a passage stands first, and just before, in other documents that hold a piece of it only."""
    monkeypatch.setattr(passages, "CELL", cell)
    rng = random.Random(9)
    own = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    p = own(80)
    pieces = [p[k : k + 20] for k in range(0, 80, 4)]
    edited = [w if k not in (30, 50) else "other" for k, w in enumerate(p)]
    rows = [(100, own(30) + p + own(30)), (200, own(10) + p + own(50)), (300, edited + own(40))]
    for at in (1, 101, 201):
        rows += [(at + k, own(20) + x + own(20)) for k, x in enumerate(pieces)]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = run(spark, rows)
    assert got == {100: [(30, 110, 100)], 200: [(10, 90, 100)], 300: [(0, 80, 100)]}


def test_worth_drops_no_pair_that_can_share_a_passage():
    rng = np.random.default_rng(3)
    wide = 2 * passages.AROUND + 2 * passages.K + passages.MAX_GAP
    same = rng.random((400, wide)) < rng.choice([0.05, 0.5, 0.85], (400, 1))
    same[:, passages.AROUND : passages.AROUND + 20] = True
    kept = passages._worth(same, 20, 50, 0.8)
    assert 0 < kept.sum() < 400
    assert all(k or not passages.stretches(x, 50, 0.8) for k, x in zip(kept, same))


def meet(texts, seeds_at):
    """The matches of one cell whose rows are texts of 16-bit words, each with two seeds at these places."""
    import pyarrow as pa

    wide, cols = 2 * passages.AROUND + 2 * passages.K + passages.MAX_GAP, defaultdict(list)
    for side in (0, 1):
        for doc, (words, (at, after)) in enumerate(zip(texts, seeds_at)):
            padded = np.concatenate((np.zeros(passages.AROUND, np.uint16), np.array(words, np.uint16), np.zeros(wide, np.uint16)))
            for name, value in (("key", 1), ("i", 0), ("j", 0), ("side", side), ("doc", doc), ("label", doc), ("at", at), ("next", after), ("inside", False), ("out", True), ("words", padded[at : at + wide].tobytes())):
                cols[name].append(value)
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))
    return [tuple(r.values()) for out in passages._meeting(50, 0.8)(iter([batch])) for r in out.to_pylist()]


@pytest.mark.parametrize("equal, found", [(60, 39), (48, 0)])
def test_a_cell_gives_rows_with_its_documents_not_their_square(equal, found):
    """op5_passages: 40 documents that share a run of words give a row of pairs, or none where the run is no passage."""
    rng = np.random.default_rng(5)
    run = rng.integers(1, 60_000, equal)
    starts = rng.integers(20, 90, 40)
    texts = [np.concatenate((rng.integers(1, 60_000, s), run, rng.integers(1, 60_000, 50))) for s in starts]
    got = meet(texts, [(s + 20, s + 28) for s in starts])
    assert len(got) == 2 * found
    joined = {0}
    for a, _, b, _ in sorted(got):
        joined |= {a, b}
    assert joined == set(range(40 if found else 1))


def test_a_cell_tells_of_longer_passages_of_repeated_words():
    """op5_passages: a word repeated has one seed, so each longer run of it that two texts share is told."""
    texts = [[k + 2, *range(100, 108), *[7] * n, k + 3] for k, n in enumerate((60, 50, 60))]
    got = meet(texts, [(1, 9)] * 3)
    assert {(a, b) for a, _, b, _ in got} == {(1, 0), (2, 0)}


def test_seeds_of_one_document_are_not_kept(spark, monkeypatch):
    """Behind the matches nothing needs the table of all seeds, the largest of the job."""
    import os

    from gleaner.llm.common import shared_dir

    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    left, compared = [], passages._compared
    monkeypatch.setattr(passages, "_compared", lambda *a: left.append({x[:-33] for x in os.listdir(top)}) or compared(*a))
    same = " ".join(f"same{k}" for k in range(70))
    rows = [(1, f"one two {same}"), (2, f"{same} three"), (3, " ".join(f"other{k}" for k in range(80)))]
    got = passages.shared_passages(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.class_id) for r in got) == [(1, 2, 72, 1), (2, 0, 70, 1)]
    assert len(left) == 2 and not any("seeds" in x for x in left)
