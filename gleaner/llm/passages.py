"""Substring dedup by collinear chaining: fuzzy passages that documents share.

1. Seeds: words (A-Z lower-cased, without ASCII punctuation around them) are hashed, every run of K
   words is a k-mer, and the smallest of each WINDOW neighbouring k-mers is a seed, so that any
   common run of K + WINDOW - 1 words shares one.
2. Matches: within a batch of documents, and then among the first documents of all batches, each
   occurrence of a seed is matched with the seed's first document and with the one before it. A seed
   of many documents thus gives two matches a document, and at most one row a batch is shuffled by it.
3. Chains: the matches of two documents, neighbours on a diagonal merged, are chained: a sweep over
   one text, a Fenwick tree of prefix maxima over the other, and a cost for the words between. Chains
   are cut at gaps over MAX_GAP words; those of one seed only are dropped.
4. Alignment: chained spans are cut out of the texts and aligned word by word; a passage is a stretch
   that scores best, of at least `min_words` words of which `min_same` are equal.
5. The rest: two seeds in the reach of a chain are a key. Documents with a key in common meet in cells, all with all, if they are
   not of one class with both seeds in passages found; they are aligned there, and a pair leaves its task only if it shares a
   passage around the seeds, and only while that joins groups of the cell or, where k-mers repeat, makes a passage longer. Steps 3
   and 4 follow again.
6. Passages of a document that overlap are one. The class of a passage is the smallest id that its
   document reaches over the pairs found.

Exact copies need no treatment of their own: each is chained to the first and to the one before it.

Cases: a null or empty text, and one with fewer than `min_words` words, has no passage. Rows repeating an id are one document with the text that sorts first. A null id takes no
part. A passage that repeats within one document only is none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import forget, q, written
from gleaner.llm.components import components

K = 6
WINDOW = 10
MIN_WORDS = 50
MIN_SAME = 0.8
GAP_COST = 0.1  # for each word of either text between two fragments of a chain
MAX_GAP = 64
EDGE = 64  # words added on both sides of a chain before it is aligned
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIX = np.uint64(0x9E3779B97F4A7C15)
CELL = 1 << 10
AROUND = 2 * K + MAX_GAP + 4  # words on both sides of two seeds that are looked at
OWN = 2 * (K + WINDOW - 1)  # equal words in a row that hold two seeds
MATCH = "doc long, at int, other_doc long, other_at int"


def word_hashes(text: bytes) -> np.ndarray:
    digest, strip = xxhash.xxh64_intdigest, PUNCTUATION
    return np.array([digest(w.strip(strip) or w) for w in text.lower().split()], np.uint64)


def seeds(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the k-mers that are smallest among `window` neighbours."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        mers = np.zeros(n, np.uint64)
        for j in range(k):
            mers = mers * np.uint64(0x100000001B3) + words[j : j + n]
        mers = (mers ^ (mers >> np.uint64(31))) * MIX
        mers ^= mers >> np.uint64(29)
    if n <= window:
        at = np.array([int(mers.argmin())])
    else:
        least = mers[: n - window + 1].copy()
        for j in range(1, window):
            np.minimum(least, mers[j : n - window + 1 + j], out=least)
        # a k-mer is chosen if it is the least of a window that holds it
        padded = np.concatenate((np.full(window - 1, 0, np.uint64), least, np.full(window - 1, 0, np.uint64)))
        most = padded[:n].copy()
        for j in range(1, window):
            np.maximum(most, padded[j : j + n], out=most)
        at = np.flatnonzero(mers <= most)
    return mers[at], at


def _two_matches(seed: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (seed, doc): of each row the number of its seed's first row and of the row before
    (-1: none or the same), and which rows are first."""
    n = len(seed)
    first = np.ones(n, bool)
    first[1:] = seed[1:] != seed[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    before = np.where(first, -1, np.arange(n) - 1)
    return np.where(first, -1, start), np.where(before == start, -1, before), first


def _match_rows(start, before) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of row numbers that are matches."""
    rows = [np.flatnonzero(x >= 0) for x in (start, before)]
    a, b = np.concatenate(rows), np.concatenate([start[rows[0]], before[rows[1]]])
    return a, b


def _seeds_of(min_words: int):
    return lambda batches: _seeds(batches, min_words)


def _seeds(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Matches within a batch (other_doc set) and the first occurrence of each seed (other_doc null)."""
    for batch in batches:
        ids, found, places = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = word_hashes(x or b"")
            if len(words) < min_words:
                continue
            h, at = seeds(words)
            h, first = np.unique(h, return_index=True)  # of a k-mer that repeats in the document, the first place
            ids.append(np.full(len(h), i, np.int64))
            found.append(h)
            places.append(at[first])
        seed, doc, at = np.concatenate(found).view(np.int64), np.concatenate(ids), np.concatenate(places)
        order = np.lexsort((doc, seed))
        seed, doc, at = seed[order], doc[order], at[order].astype(np.int32)
        start, before, first = _two_matches(seed, doc, at)
        a, b = _match_rows(start, before)
        one = np.flatnonzero(first)
        none = pa.nulls(len(one), pa.int64())
        for cols in ((seed[a], doc[a], at[a], doc[b], at[b]), (seed[one], doc[one], at[one], none, pa.nulls(len(one), pa.int32()))):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["seed", "doc", "at", "other_doc", "other_at"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches among rows sorted by (seed, doc); a seed's first and last rows are carried over batches."""
    held: list[tuple[int, int, int]] = []
    for batch in batches:
        seed, doc, at = (batch.column(k).to_numpy() for k in range(3))
        carried = [h for h in held if len(seed) and h[0] == seed[0]]
        if carried:
            seed, doc, at = (np.concatenate((np.array([h[k] for h in carried], x.dtype), x)) for k, x in enumerate((seed, doc, at)))
        if not len(seed):
            continue
        start, before, _ = _two_matches(seed, doc, at)
        start[: len(carried)] = before[: len(carried)] = -1
        a, b = _match_rows(start, before)
        last = len(seed) - 1
        top = int(np.searchsorted(seed, seed[last]))
        held = [(int(seed[k]), int(doc[k]), int(at[k])) for k in sorted({top, last})]
        keep = doc[a] != doc[b]
        a, b = a[keep], b[keep]
        if len(a):
            cols = (seed[a], doc[a], at[a].astype(np.int32), doc[b], at[b].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["seed", "doc", "at", "other_doc", "other_at"])


def _near_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with their shared seeds in order (at, seed, open, inside): two seeds that can follow each other in a chain, one of
    them open."""
    for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
        lists = batch.column("list")
        at, seed, open_, inside = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        doc, label = (batch.column(c).to_numpy()[row] for c in ("doc", "label"))
        for shift in range(1, min(K + MAX_GAP, len(at) - 1) + 1):
            a = np.flatnonzero((row[shift:] == row[:-shift]) & (at[shift:] - at[:-shift] <= K + MAX_GAP))
            if not len(a):
                break
            b = a + shift
            some = open_[a] | open_[b]
            a, b = a[some], b[some]
            with np.errstate(over="ignore"):
                key = (seed[a].view(np.uint64) * MIX) ^ seed[b].view(np.uint64)
                key = ((key ^ (key >> np.uint64(29))) * MIX).view(np.int64)
            cols = (key, doc[a], label[a], at[a], at[b], inside[a] & inside[b])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "doc", "label", "at", "next", "inside"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with their near seeds: a row each, with the words around as 16-bit hashes (0: none), from AROUND words before."""
    wide = 2 * AROUND + 2 * K + MAX_GAP
    for batch in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
        lists = batch.column("list")
        rows, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        at, spans, k = rows.field("at").to_pylist(), [], 0
        for x, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), sizes.tolist()):
            words = np.zeros(AROUND, np.uint16), np.maximum(word_hashes(x).astype(np.uint16), 1), np.zeros(wide, np.uint16)
            words = np.concatenate(words)
            spans += [words[a : a + wide].tobytes() for a in at[k : k + n]]
            k += n
        doc = batch.column("doc").to_numpy()[np.repeat(np.arange(batch.num_rows), sizes)]
        names = [f.name for f in rows.type]
        yield pa.RecordBatch.from_arrays([pa.array(doc), *(rows.field(c) for c in names), pa.array(spans, pa.binary())], names=["doc", *names, "words"])


def _worth(same: np.ndarray, core: int, min_words: int, min_same: float) -> np.ndarray:
    """Whether two texts, equal on a diagonal as in each row of `same`, can share a passage around two seeds in `core` words from
    AROUND on: they are alike over min_words words, or have another run of K equal words there to chain."""
    end = AROUND + core
    before = np.where(same[:, :AROUND].all(1), AROUND, same[:, AROUND - 1 :: -1].argmin(1))
    after = np.where(same[:, end:].all(1), same.shape[1] - end, same[:, end:].argmin(1))
    run = same[:, : same.shape[1] - K + 1].copy()
    for k in range(1, K):
        run &= same[:, k : same.shape[1] - K + 1 + k]
    at = np.arange(run.shape[1])
    other = (run & ((at < AROUND - before[:, None]) | (at + K > (end + after)[:, None]))).any(1)
    rest = np.flatnonzero(~other & (same.sum(1) >= min(min_words, same.shape[1]) * min_same - 1e-9))
    if len(rest):
        if min_words >= same.shape[1]:
            other[rest] = True
        else:
            total = np.zeros((len(rest), same.shape[1] + 1))
            np.cumsum(np.where(same[rest], 1.0, -min_same / (1 - min_same)), axis=1, out=total[:, 1:])
            low = np.minimum.accumulate(total, axis=1)
            other[rest] = (total[:, min_words:] - low[:, : total.shape[1] - min_words]).max(1) > -1e-9
    return other


def _best(same: np.ndarray, min_words: int, min_same: float) -> tuple[np.ndarray, np.ndarray]:
    """As `stretches` finds them, the first stretch of at least min_words words of each row of `same`: (start, end), (0, 0) for none."""
    start, end = np.zeros((2, len(same)), np.int64)
    gain, todo, at = np.where(same, 1.0, -min_same / (1 - min_same)), np.arange(len(same)), np.arange(same.shape[1] + 1)
    while len(todo):
        total = np.zeros((len(todo), same.shape[1] + 1))
        np.cumsum(gain, axis=1, out=total[:, 1:])
        low = np.minimum.accumulate(total, axis=1)
        e = (total - low).argmax(1)
        none = e == 0
        b = same.shape[1] - ((total == low[np.arange(len(e)), e][:, None]) & (at <= e[:, None]))[:, ::-1].argmax(1)
        long = e - b >= min_words
        start[todo[long]], end[todo[long]] = b[long], e[long]
        left = ~long & ~none
        gain, b, e, todo = gain[left], b[left], e[left], todo[left]
        gain[(at[:-1] >= b[:, None]) & (at[:-1] < e[:, None])] = -1e6  # what is left lies before or behind it
        many = (gain > 0).sum(1) >= min_words * min_same - 1e-9
        gain, todo = gain[many], todo[many]
    return start, end


def _runs(same: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a row has OWN equal words in a row within its stretch, so that the stretch has two seeds of its own."""
    at = np.arange(same.shape[1])
    equal = same & (at >= start[:, None]) & (at < end[:, None])
    count = np.zeros((len(same), same.shape[1] + 1), np.int32)
    np.cumsum(equal, axis=1, out=count[:, 1:])
    return (count[:, OWN:] - count[:, :-OWN] == OWN).any(1) if same.shape[1] >= OWN else np.zeros(len(same), bool)


def _repeating(words: np.ndarray) -> np.ndarray:
    """Which rows hold a k-mer twice: what extends a passage there may have no seed of its own, as a k-mer counts at its first place."""
    mers = np.zeros((len(words), words.shape[1] - K + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            mers = mers * MIX + words[:, k : words.shape[1] - K + 1 + k]
    none = np.minimum.reduce([words[:, k : words.shape[1] - K + 1 + k] for k in range(K)]) == 0
    mers[none] = np.broadcast_to(np.arange(mers.shape[1], dtype=np.uint64), mers.shape)[none]
    mers.sort(axis=1)
    return (mers[:, 1:] == mers[:, :-1]).any(1)


def _even(same: np.ndarray, core: int, min_words: int, min_same: float) -> tuple[np.ndarray, np.ndarray]:
    """Of two texts equal on a diagonal as in each row of `same`, which has EDGE words on both sides of the `core` words of two seeds: (kind,
    spans). A kind is 0 for no passage, 1 for one beside a seed, 2 for one that holds both; 3 or 4 for the same if its own seeds tell of it;
    spans are its start and end in either text, from the first seed on."""
    kind, spans = np.zeros(len(same), np.int8), np.zeros((len(same), 4), np.int64)
    some = np.flatnonzero(same.sum(1) >= min_words * min_same - 1e-9)
    start, end = _best(same[some], min_words, min_same)
    both = (start <= EDGE) & (end >= EDGE + core)
    kind[some] = np.where(end == 0, 0, np.where(both, 2, 1) + 2 * _runs(same[some], start, end))
    spans[some] = np.stack((start, end, start, end), 1) - EDGE
    return kind, spans


def _uneven(x: np.ndarray, gap: int, ys: np.ndarray, gaps: np.ndarray, min_words: int, min_same: float) -> tuple[np.ndarray, np.ndarray]:
    """The same as `_even` where the seeds lie on two diagonals, the words between aligned by a longest common subsequence."""
    kinds, spans = np.zeros(len(ys), np.int8), np.zeros((len(ys), 4), np.int64)
    before = (ys[:, AROUND - EDGE : AROUND] == x[AROUND - EDGE : AROUND]) & (x[AROUND - EDGE : AROUND] != 0)
    behind = np.arange(EDGE) + AROUND + K
    after = (ys[np.arange(len(ys))[:, None], behind + gaps[:, None]] == x[behind + gap]) & (x[behind + gap] != 0)
    gain = lambda same: np.where(same, 1.0, -min_same / (1 - min_same))
    reach = lambda same: EDGE - np.concatenate((np.zeros((len(same), 1)), np.cumsum(gain(same), axis=1)), axis=1)[:, ::-1].argmax(1)
    # with all words between equal no stretch over both seeds is longer; one beside them has its own best
    most = reach(before[:, ::-1]) + reach(after) + np.maximum(gap, gaps) + K
    apart = (gap >= K) & (gaps >= K)  # seeds that overlap on two diagonals never make a chain
    rows = np.flatnonzero(apart & ((most >= min_words) | (before.sum(1) >= min_words * min_same) | (after.sum(1) >= min_words * min_same)))
    core_x, seed = x[AROUND + K : AROUND + gap], np.ones(K, bool)
    cores = {k: ys[k, AROUND + K : AROUND + gaps[k]] for k in rows.tolist()}
    some, both, own = np.zeros(len(ys), bool), np.ones(len(ys), bool), np.ones(len(ys), bool)
    for side, wide in enumerate((np.full(len(ys), gap), gaps)):
        for core in np.unique(wide[rows]).tolist():  # rows of one length go together
            at = rows[wide[rows] == core]
            same = np.stack([np.concatenate((before[k], seed, _gap(cores[k], core_x) if side else _gap(core_x, cores[k]), seed, after[k])) for k in at.tolist()])
            start, end = _best(same, min_words, min_same)
            held = end > 0
            spans[at[held], 2 * side], spans[at[held], 2 * side + 1] = start[held] - EDGE, end[held] - EDGE
            some[at] |= held
            both[at] &= held & (start <= EDGE) & (end >= EDGE + core + K)
            own[at] &= ~held | _runs(same, start, end)
    kinds[rows] = np.where(some[rows], np.where(both[rows], 2, 1) + 2 * own[rows], 0)
    return kinds, spans


def _meeting(min_words: int, min_same: float):
    """Matches of the rows of each cell (key, i, j): those of side 0 with those of side 1, if they share a passage there. Rows that passages
    of both seeds join are of one group. In a group a pair is left out where both seeds are covered and no k-mer repeats, as what
    makes a passage longer has seeds of its own then, or else where it covers no more words of either text. Cells come sorted."""

    def cell(side, doc, label, at, after, inside, out, words) -> Iterator[tuple[np.ndarray, ...]]:
        n = int(np.searchsorted(side, 1))
        gap = after - at
        docs, row, who = np.unique(doc, return_index=True, return_inverse=True)
        group, again = np.arange(len(docs)), _repeating(words[row])
        for x in np.unique(label[inside]):
            held = who[inside & (label == x)]
            group[held] = held[0]
        covered = np.zeros((len(docs), 2 * EDGE + 2 * K + MAX_GAP), bool)

        def kinds(a: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            kind, spans, even = np.zeros(len(b), np.int8), np.zeros((len(b), 4), np.int64), gap[b] == gap[a]
            core, dense = int(gap[a]) + K, np.zeros(len(b), bool)
            good = np.flatnonzero(even)
            if len(good):
                same = (words[b[good]] == words[a]) & (words[a] != 0)
                dense[good] = same[:, AROUND : AROUND + core].all(1) & (gap[a] > WINDOW)
                worth = _worth(same, core, min_words, min_same)
                kind[good[worth]], spans[good[worth]] = _even(same[worth, AROUND - EDGE : AROUND + core + EDGE], core, min_words, min_same)
            if not even.all():
                kind[~even], spans[~even] = _uneven(words[a], int(gap[a]), words[b[~even]], gap[b[~even]], min_words, min_same)
            return kind, spans, dense

        for a in range(n):
            todo, me = n + np.flatnonzero((doc[n:] != doc[a]) & (~out[n:] | (doc[n:] < doc[a])) & ~(inside[a] & inside[n:] & (label[n:] == label[a]))), who[a]
            for rest in (False, True):  # one row of each group first, then all that are left
                b = todo = todo[again[me] | again[who[todo]] | (group[who[todo]] != group[me])]
                if not rest:
                    now = np.unique(group[who[todo]], return_index=True)[1]
                    b, todo = todo[now], np.delete(todo, now)
                if not len(b):
                    continue
                kind, spans, dense = kinds(a, b)
                linked = dense | (GAP_COST * (gap[b] + gap[a] - 2 * K) < K)
                told = []
                for k in np.flatnonzero(kind).tolist():
                    you, rep = who[b[k]], again[me] or again[who[b[k]]]
                    sure, own = linked[k] and kind[k] in (2, 4), kind[k] > 2
                    if not rep and not sure and own:
                        continue
                    mine, yours = (slice(EDGE + spans[k, c], EDGE + spans[k, c + 1]) for c in (0, 2))
                    new = not (covered[me, mine].all() and covered[you, yours].all())
                    if sure and group[me] == group[you] and not (rep and new) or linked[k] and not sure and not new:
                        continue
                    if rep or not dense[k]:  # else both have a seed between these, which tells the same
                        told.append(k)
                    if linked[k]:
                        covered[me, mine] = covered[you, yours] = True
                    if sure:
                        group[group == group[you]] = group[me]
                b = b[told]
                for x in (at, after) if len(b) else ():
                    first = doc[b] < doc[a]
                    yield np.where(first, doc[a], doc[b]), np.where(first, x[a], x[b]), np.where(first, doc[b], doc[a]), np.where(first, x[b], x[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _ended(batches):
            if batch is not None:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "doc", "label", "at", "next", "inside", "out")]
                cols.append(np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint16).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 2 * AROUND + 2 * K + MAX_GAP), np.uint16))
                held = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
            if held is None or not len(held[0]):
                continue
            key, i, j = held[:3]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = [0, *cuts.tolist(), *([len(key)] if batch is None else [])]
            found = [m for a, b in zip(bounds, bounds[1:]) for m in cell(*(c[a:b] for c in held[3:]))]
            held = [c[bounds[-1] :] for c in held]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["doc", "at", "other_doc", "other_at"])

    return run


def _ended(batches: Iterator) -> Iterator:
    """The batches, and None behind them."""
    yield from batches
    yield None


class Fenwick:
    """Prefix maxima of (value, fragment)."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, k: int, value: tuple[float, int]) -> None:
        k += 1
        while k < len(self.best):
            if value > self.best[k]:
                self.best[k] = value
            k += k & -k

    def upto(self, k: int) -> tuple[float, int]:
        """The best of places 0 to k - 1."""
        out = (-1e18, -1)
        while k > 0:
            if self.best[k] > out:
                out = self.best[k]
            k -= k & -k
        return out


def fragments(x: np.ndarray, y: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(x, y, length) of matches merged along their diagonal where they follow within k + WINDOW words."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = ((x - y)[1:] != (x - y)[:-1]) | (x[1:] - x[:-1] > k + WINDOW)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(x)) - 1
    return list(zip(x[at].tolist(), y[at].tolist(), (x[ends] - x[at] + k).tolist()))


def chains(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint collinear chains of fragments, best first; a fragment follows one that ends before it in both texts."""
    ys = sorted({y + n for _, y, n in parts})
    tree = Fenwick(len(ys))
    score, back = [0.0] * len(parts), [-1] * len(parts)
    events = sorted([(x + n, 0, m) for m, (x, _, n) in enumerate(parts)] + [(x, 1, m) for m, (x, _, _) in enumerate(parts)])
    for _, start, m in events:
        x, y, n = parts[m]
        if start:
            value, prev = tree.upto(bisect_left(ys, y + 1))
            linked = value - GAP_COST * (x + y)
            score[m], back[m] = (n + linked, prev) if prev >= 0 and linked > 0 else (float(n), -1)
        else:
            tree.put(bisect_left(ys, y + n), (score[m] + GAP_COST * (x + y + 2 * n), m))
    out, used = [], [False] * len(parts)
    for m in sorted(range(len(parts)), key=lambda m: -score[m]):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(parts[m])
            m = back[m]
        if chain:
            chain.reverse()
            cut = [0] + [j for j in range(1, len(chain)) if max(chain[j][0] - chain[j - 1][0] - chain[j - 1][2], chain[j][1] - chain[j - 1][1] - chain[j - 1][2]) > MAX_GAP] + [len(chain)]
            out += [chain[a:b] for a, b in zip(cut, cut[1:])]
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the matches of each two documents; rows come sorted by them, and two documents' matches are as
    many as one has seeds at most. Of documents with a single match nothing is made."""
    held: list[np.ndarray] | None = None

    def made(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray] | None, pa.RecordBatch | None]:
        doc, other, x, y = cols
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1])) + 1
        bounds = np.concatenate(([0], cuts, [len(doc)]))
        many = len(bounds) - (1 if last else 2)
        rows = []
        for g in np.flatnonzero(np.diff(bounds[: many + 1]) > 1).tolist():
            a, b = bounds[g], bounds[g + 1]
            no = 0
            for c in chains(fragments(x[a:b].astype(np.int64), y[a:b].astype(np.int64))):
                if c[-1][0] + c[-1][2] - c[0][0] > K:
                    rows.append((int(doc[a]), int(other[a]), no, [f[0] for f in c], [f[1] for f in c], [f[2] for f in c]))
                    no += 1
        rest = None if last else [c[bounds[many] :] for c in cols]
        if not rows:
            return rest, None
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3)
        return rest, pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc", "other", "no", "xs", "ys", "ns"])

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(4)]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        if len(cols[0]):
            held, out = made(cols, False)
            if out is not None:
                yield out
    if held is not None and len(held[0]):
        _, out = made(held, True)
        if out is not None:
            yield out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., from, words): the hashed words of a span of the text in the last column."""
    last, words = None, np.empty(0, np.uint32)
    for batch in (whole.slice(k, 128) for whole in batches for k in range(0, whole.num_rows, 128)):
        spans = []
        for lo, hi, x in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if x != last:
                last, words = x, word_hashes(x).astype(np.uint32)
            spans.append(words[lo:hi].tobytes())
        cols = [batch.column(c) for c in ("doc", "other", "no", "side")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.binary())], names=["doc", "other", "no", "side", "words"])


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each word of x, whether a longest common subsequence with y has it."""
    if len(x) == len(y):
        return x == y
    same, places = np.zeros(len(x), bool), {}
    for j, word in enumerate(y.tolist()):
        places[word] = places.get(word, 0) | 1 << j
    every = (1 << len(y)) - 1
    steps, rest = [0], every  # for each start of x, a bit for each start of y whose last word makes the subsequence longer
    for word in x.tolist():
        met = rest & places.get(word, 0)
        rest = ((rest + met) | (rest - met)) & every
        steps.append(every ^ rest)
    i, j = len(x), len(y)
    while i and j:
        start = (1 << j) - 1
        if (steps[i] & start).bit_count() == (steps[i - 1] & start).bit_count():
            i -= 1
        elif not steps[i] >> (j - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            same[i] = True
    return same


def align(x: np.ndarray, y: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, int]:
    """(same, from): for the words of x from `from` on, whether the alignment along the fragments pairs them with an equal word of y."""
    out = []
    px, py, n = parts[0]
    head = min(px, py, EDGE)
    start = px - head
    out.append(x[px - head : px] == y[py - head : py])
    ex, ey = px, py
    for px, py, n in parts:
        if px > ex or py > ey:
            out.append(_gap(x[ex:px], y[ey:py]))
        shift = max(0, ex - px)
        out.append(x[px + shift : px + n] == y[py + shift : py + n])
        ex, ey = px + n, py + n
    tail = min(len(x) - ex, len(y) - ey, EDGE)
    out.append(x[ex : ex + tail] == y[ey : ey + tail])
    return np.concatenate(out), start


def stretches(same: np.ndarray, min_words: int, min_same: float) -> list[tuple[int, int]]:
    """Disjoint best-scoring stretches of at least min_words words: an equal word counts 1, another as much
    less that a share of min_same breaks even."""
    out, todo = [], [(0, len(same))]
    gain = np.where(same, 1.0, -min_same / (1 - min_same))
    while todo:
        a, b = todo.pop()
        if b - a < min_words:
            continue
        total = np.concatenate(([0.0], np.cumsum(gain[a:b])))
        low = np.minimum.accumulate(total)
        end = int((total - low).argmax())
        begin = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
        if end - begin >= min_words:
            out.append((a + begin, a + end))
            todo += [(a, a + begin), (a + end, b)]
        elif end > begin:
            todo += [(a, a + begin), (a + end, b)]
    return sorted(out)


def _aligned(min_words: int, min_same: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, 128) for batch in batches for k in range(0, batch.num_rows, 128)):
            out: list[tuple] = []
            for r in part.to_pylist():
                x, y = np.frombuffer(r["x"], np.uint32), np.frombuffer(r["y"], np.uint32)
                x0, y0 = r["x0"], r["y0"]
                parts = [(a - x0, b - y0, n) for a, b, n in zip(r["xs"], r["ys"], r["ns"])]
                for one, two, swap, doc, base in ((x, y, False, r["doc"], x0), (y, x, True, r["other"], y0)):
                    same, start = align(one, two, [(b, a, n) if swap else (a, b, n) for a, b, n in parts])
                    out += [(doc, r["doc"], r["other"], base + start + a, base + start + b) for a, b in stretches(same, min_words, min_same)]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.int32()) for c in cols[3:])], names=["of", "doc", "other", "start", "end"])

    return run


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_same: float = MIN_SAME) -> DataFrame:
    """(doc_id, start_word, end_word, class_id): the passages, end excluded, that each document shares with others."""
    spark = docs.sparkSession
    rows = docs.select(q(id_col).cast("long").alias("doc"), q(text_col).alias("text")).filter("doc is not null")
    rows = rows.groupBy("doc").agg(F.min("text").alias("text")) if _repeats(rows) else rows
    found = written(rows.mapInArrow(_seeds_of(min_words), f"seed long, {MATCH}"), "seeds")
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    firsts = found.filter("other_doc is null").select("seed", "doc", "at").repartition(parts, "seed").sortWithinPartitions("seed", "doc")
    across = written(firsts.mapInArrow(_across, f"seed long, {MATCH}"), "matches-across")
    within = written(found.filter("other_doc is not null"), "matches-within")
    forget(found)  # most seeds are of one document only
    matches = within.union(across)
    spans = _compared(matches.drop("seed"), rows, parts, min_words, min_same)
    classes = _classes(spans)
    rest = _rest(matches, spans, classes, rows, parts, min_words, min_same)
    forget(within, across)
    spans = spans.union(_compared(rest, rows, parts, min_words, min_same))
    label = _classes(spans)
    merged = _merged(spans.select("of", "start", "end").distinct())
    merged = merged.join(label, merged.of == label.node)
    return merged.select(F.col("of").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("label").alias("class_id"))


def _classes(spans: DataFrame) -> DataFrame:
    return written(components(spans.select(F.col("doc").alias("a"), F.col("other").alias("b"))), "passage-classes")


def _compared(matches: DataFrame, rows: DataFrame, parts: int, min_words: int, min_same: float) -> DataFrame:
    """(of, doc, other, start, end): the passages of `of` that the matches of doc and other lead to."""
    matches = matches.select("doc", "other_doc", "at", "other_at").repartition(parts, "doc", "other_doc").sortWithinPartitions("doc", "other_doc")
    chained = written(matches.mapInArrow(_chained, "doc long, other long, no int, xs array<int>, ys array<int>, ns array<int>"), "chains")

    lo, hi = (lambda s: F.greatest(F.element_at(s, 1) - EDGE, F.lit(0))), (lambda s: F.element_at(s, -1) + F.element_at("ns", -1) + EDGE)
    ask = [chained.select("doc", "other", "no", F.lit(k).alias("side"), F.col(d).alias("wanted"), lo(s).alias("lo"), hi(s).alias("hi")) for k, (d, s) in enumerate((("doc", "xs"), ("other", "ys")))]
    ask = ask[0].union(ask[1]).join(rows.select(F.col("doc").alias("wanted"), "text").hint("merge"), "wanted")
    cut = written(ask.select("doc", "other", "no", "side", "lo", "hi", "text").mapInArrow(_cut_out, "doc long, other long, no int, side int, words binary"), "span-words")
    both = chained.join(cut.filter("side = 0").select("doc", "other", "no", F.col("words").alias("x")), ["doc", "other", "no"])
    both = both.join(cut.filter("side = 1").select("doc", "other", "no", F.col("words").alias("y")), ["doc", "other", "no"])
    both = both.select("doc", "other", "xs", "ys", "ns", "x", "y", lo("xs").alias("x0"), lo("ys").alias("y0"))
    out = written(both.mapInArrow(_aligned(min_words, min_same), "of long, doc long, other long, start int, end int"), "spans")
    forget(chained, cut)
    return out


def _rest(matches: DataFrame, spans: DataFrame, classes: DataFrame, text: DataFrame, parts: int, min_words: int, min_same: float, cell: int | None = None) -> DataFrame:
    """Matches of documents that share two seeds in the reach of a chain and a passage around them (see `_meeting`), but for those
    whose documents are of one class already and hold both seeds in passages found.

    Each row of a shared seed is in a match. A seed is open unless all its rows are of one class and in passages; of two seeds near
    each other, one open, rows outside the largest such group meet all others, in cells of about `cell` rows a side."""
    cell = cell or CELL
    rows = matches.select("seed", "doc", "at").union(matches.select("seed", F.col("other_doc").alias("doc"), F.col("other_at").alias("at"))).distinct()
    held = _merged(spans.select("of", "start", "end").distinct()).groupBy("of").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    held = held.join(classes, held.of == classes.node).select(F.col("of").alias("doc"), "spans", "label")
    rows = rows.join(held, "doc", "left")
    inside = F.coalesce(F.exists("spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") + K <= s["end"])), F.lit(False))
    rows = shared = written(rows.select("seed", "doc", "at", F.coalesce("label", "doc").alias("label"), inside.alias("inside")), "shared-seeds")
    open_ = rows.groupBy("seed").agg((~F.min("inside") | (F.min("label") < F.max("label"))).alias("open"))
    rows = rows.join(open_, "seed").groupBy("doc", "label").agg(F.array_sort(F.collect_list(F.struct("at", "seed", "open", "inside"))).alias("list"))
    rows = rows.filter(F.exists("list", lambda r: r["open"]) & (F.size("list") > 1))
    near = written(rows.mapInArrow(_near_seeds, "key long, doc long, label long, at int, next int, inside boolean"), "near-seeds")
    forget(shared)
    groups = near.groupBy("key", "label", "inside").agg(F.count("*").alias("rows"))
    top = F.max(F.struct(F.when(F.col("inside"), F.col("rows")).otherwise(0).alias("rows"), "label"))
    keys = groups.groupBy("key").agg(F.sum("rows").alias("all"), top.alias("top")).filter("all > 1 and all > top.rows")
    keys = written(keys.select("key", "all", F.col("top.rows").alias("most"), F.when(F.col("top.rows") > 0, F.col("top.label")).alias("top")), "near-seed-keys")
    met = near.join(keys, "key").withColumn("out", ~(F.col("inside") & F.coalesce(F.col("label") == F.col("top"), F.lit(False))))
    met = met.withColumns({"is": F.ceil((F.col("all") - F.col("most")) / cell).cast("int"), "js": F.ceil(F.col("all") / cell).cast("int")})
    row = ["key", "label", "at", "next", "inside", "out", "is", "js"]
    lists = written(met.groupBy("doc").agg(F.collect_list(F.struct(*row)).alias("list")), "open-near-seeds")
    forget(near, keys)
    text = text.join(lists.select("doc"), "doc", "left_semi").join(lists, "doc").select("doc", "text", "list")
    met = written(text.mapInArrow(_contexts, "doc long, key long, label long, at int, next int, inside boolean, out boolean, is int, js int, words binary"), "contexts")
    forget(lists)
    over = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")
    row = ["key", "i", "j", "side", "doc", "label", "at", "next", "inside", "out", "words"]
    left = met.filter("out").withColumns({"side": F.lit(0), "i": deal("is")}).withColumn("j", over("js")).select(row)
    right = met.withColumns({"side": F.lit(1), "j": deal("js")}).withColumn("i", over("is")).select(row)
    cells = left.union(right).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "doc")
    out = written(cells.mapInArrow(_meeting(min_words, min_same), MATCH).distinct(), "rest-matches")
    forget(met)
    return out


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc").count().filter("count > 1").limit(1).count())


def _merged(spans: DataFrame) -> DataFrame:
    """The union of the spans of each document; a document's spans are few, as each has at least min_words words of it."""
    order = W.partitionBy("of").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    rows = rows.withColumn("no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("of", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
