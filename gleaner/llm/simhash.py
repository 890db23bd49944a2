"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are cut into `blocks` bit ranges; two that differ in at most `radius` bits agree in
at least blocks - radius of them, so for every choice of that many ranges the fingerprints with
equal bits there form a bucket, and each link lies in a bucket. How many ranges is chosen by the
number of fingerprints: few coarse tables for a small corpus, more and finer ones for a large one.

Within a bucket the fingerprints stand as 64 bit planes, 64 fingerprints to a word. A block of
queries runs over the planes with carry-save counters; a query whose distances all exceed the
radius is abandoned every 16 planes. Buckets over CELL fingerprints are cut into chunks, and each
pair of chunks is a cell of its own, so a hot bucket spreads over many tasks. A cell sends out a
spanning forest of its links, not all pairs.

Cases: null and empty texts have the fingerprint zero, linked like any other. Equal fingerprints
are always one component. Rows repeating a doc_id stand for the same document. A null doc_id never
names a component; a component of null doc_ids only has a null component_id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, q, written
from gleaner.llm.components import components

CELL = 1 << 15
QUERIES = 256
BLOCK_WORDS = 1 << 13  # of a plane times queries: the counters stay in the cache
TILE = 256
SEED = 42
BANDS, GROUP = 32, 4  # a pair of likeness 0.8 shares no key with a chance of (1 - 0.8 ** 4) ** 32, 5 in 10^8
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * GROUP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FAR = 22  # bits a fingerprint, on average; 9.7 at a likeness of 0.8
BINS = 512  # of a sketch, four bits each
MARGIN = 0.08  # of a likeness that a sketch estimates with a deviation of 0.019 at most: over four of them
PAIR_CELL = 1 << 12
SMALL_CELL = 48
ROUNDS = (4, None)  # pairs a text; see near_duplicates
ROW_COST, PAIR_COST = 6e-6, 2e-9  # seconds; only their ratio matters, for the choice of tables


def shingle_spans(text: bytes, words: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The text A-Z lower-cased with single spaces, and where its shingles start and end in it."""
    parts = text.lower().split()
    if not parts:
        return b"", []
    ends = list(itertools.accumulate(len(w) + 1 for w in parts))
    starts = [0, *ends[:-1]]
    if len(parts) <= words:
        return b" ".join(parts), [(0, ends[-1] - 1)]
    return b" ".join(parts), [(a, b - 1) for a, b in zip(starts, ends[words - 1 :])]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    flat, spans = shingle_spans(text, words)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Unsigned; a bit is 1 if it is set in over half of the shingle hashes."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                got = np.array([fingerprint(x or b"", words) for x in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])

    return run


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each whole text."""
    return docs.select(q(id_col).cast("long").alias("id"), q(text_col).alias("text")).mapInArrow(_fingerprints(words), "id long, fp long")


def tables_for(n: int, radius: int) -> list[list[int]]:
    """Masks of bits that agree, as lists of bit numbers: every pair within the radius agrees on one of them."""
    best = None
    for blocks in range(radius + 1, min(64, radius + 8) + 1):
        agree = blocks - radius
        tables = math.comb(blocks, agree)
        if tables > 3000:
            break
        cost = n * tables * ROW_COST + n * n / 2 * tables / 2 ** (64 * agree / blocks) * PAIR_COST
        if best is None or cost < best[0]:
            best = (cost, blocks, agree)
    _, blocks, agree = best
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [[b for k in chosen for b in range(cuts[k], cuts[k + 1])] for chosen in itertools.combinations(range(blocks), agree)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of words for each word of a fingerprint: bit i of word w in row p is bit p of fingerprint 64 w + i."""
    if fps.ndim > 1:
        return np.concatenate([planes_of(np.ascontiguousarray(fps[:, k])) for k in range(fps.shape[1])])
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _add(counter: list[np.ndarray], carry: np.ndarray, level: int) -> None:
    """Adds a word of bits of weight 2**level to a bit-sliced counter."""
    while level < len(counter):
        counter[level], carry = counter[level] ^ carry, counter[level] & carry
        level += 1
    counter.append(carry)


def _within(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is at most the radius, by a bitwise comparison from the top."""
    less, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            less |= equal & ~counter[level]
            equal &= counter[level]
        else:
            equal &= ~counter[level]
    if radius >> len(counter):
        return np.full_like(less, ~np.uint64(0))
    return less | equal


def near(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row in queries, fingerprint number) of all pairs within the radius; a fingerprint is a word or a row of words."""
    rows = np.arange(len(queries))
    queries = queries.reshape(len(queries), -1)
    counter: list[np.ndarray] = []
    last = np.full(planes.shape[1], ~np.uint64(0))
    if n % 64:
        last[-1] = np.uint64((1 << n % 64) - 1)
    alive = None
    for start in range(0, len(planes), 16):
        held: dict[int, np.ndarray] = {}
        for p in range(start, start + 16, 2):
            bit = (queries[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
            x = planes[p][None, :] ^ (np.uint64(0) - bit)[:, None]
            bit = (queries[:, p // 64] >> np.uint64(p % 64 + 1)) & np.uint64(1)
            y = planes[p + 1][None, :] ^ (np.uint64(0) - bit)[:, None]
            total, carry, level = x ^ y, x & y, 1
            if 0 in held:  # a full adder over the waiting bit and the two new ones
                z = held.pop(0)
                carry, total = carry | (total & z), total ^ z
            held[0] = total
            while level in held:
                z = held.pop(level)
                if len(counter) <= level:
                    counter.extend(np.zeros_like(z) for _ in range(level + 1 - len(counter)))
                c = counter[level]
                counter[level], carry = c ^ z ^ carry, (c & z) | (carry & (c ^ z))
                level += 1
            held[level] = carry
        for level, bits in sorted(held.items()):
            if len(counter) < level:
                counter.extend(np.zeros_like(bits) for _ in range(level - len(counter)))
            _add(counter, bits, level)
        alive = _within(counter, radius) & last
        keep = alive.any(axis=1)
        if not keep.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if not keep.all():
            rows, queries, alive, counter = rows[keep], queries[keep], alive[keep], [c[keep] for c in counter]
    row, word = np.nonzero(alive)
    bits = np.unpackbits(alive[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return rows[row[at]], word[at] * 64 + bit


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def cell_links(left: np.ndarray, right: np.ndarray | None, radius: int, extra: int = 0) -> list[tuple[int, int]]:
    """Links that connect all that is within the radius in a cell: within left, or between left and
    right. `extra`: as many nearest links of each fingerprint besides."""
    cols = left if right is None else right
    planes, forest, out = planes_of(cols), _Forest(len(left) + (0 if right is None else len(right))), []
    off = 0 if right is None else len(left)
    block = max(32, min(QUERIES, BLOCK_WORDS // planes.shape[1]))
    for k in range(0, len(left), block):
        part = left[k : k + block]
        n = len(cols) if right is not None else k + len(part)  # below the diagonal only
        row, col = near(part, planes[:, : -(-n // 64)], n, radius)
        row = row + k
        if right is None:
            row, col = row[row > col], col[row > col]
        if not len(row):
            continue
        apart = np.bitwise_count(left[row] ^ cols[col])
        order = np.lexsort((col, apart, row))
        row, col = row[order].tolist(), col[order].tolist()
        taken, prev = 0, -1
        for a, b in zip(row, col):
            taken, prev = (taken if a == prev else 0), a
            if forest.join(a, b + off) or taken < extra:
                taken += 1
                out.append((int(left[a]), int(cols[b])))
    return out


def _links(radius: int, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; cells of one chunk that are small share a tile."""
        cell, sides, tile = None, ([], []), []

        def out(links):
            if links:
                got = np.array(links, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        def flush_tile():
            nonlocal tile
            if tile:
                fps, tile = np.unique(np.concatenate(tile)), []
                yield from out(cell_links(fps, None, radius, extra))

        def flush():
            if cell is None:
                return
            a, b = (np.concatenate(x) if x else None for x in sides)
            if b is None and a is not None and cell[2] == cell[3]:
                if len(a) >= TILE:
                    yield from out(cell_links(np.unique(a), None, radius, extra))
                elif len(a) > 1:
                    tile.append(a)
                    if sum(map(len, tile)) >= TILE:
                        yield from flush_tile()
            elif a is not None and b is not None:
                yield from out(cell_links(np.unique(a), np.unique(b), radius, extra))

        for batch in batches:
            t, key, i, j, side = (batch.column(k).to_numpy() for k in range(5))
            fps = batch.column(5).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(t)]):
                now = (t[a], key[a], i[a], j[a])
                if now != cell:
                    yield from flush()
                    cell, sides = now, ([], [])
                on = side[a:b] == 1
                for s, part in ((0, fps[a:b][~on]), (1, fps[a:b][on])):
                    if len(part):
                        sides[s].append(part)
        yield from flush()
        yield from flush_tile()

    return run


def links(fps: DataFrame, radius: int, extra: int = 0, cell: int | None = None) -> DataFrame:
    """(a, b) fingerprints within the radius that connect all linked ones; fps: one row per fingerprint."""
    spark, cell = fps.sparkSession, cell or CELL
    n = fps.count()
    masks = tables_for(n, radius)
    keys = F.array(*(F.struct(F.lit(k).alias("t"), F.expr(f"fp & {mask - (1 << 64) if mask >> 63 else mask}L" if mask != 1 << 63 else "fp & (-9223372036854775807L - 1L)").alias("key")) for k, mask in enumerate(sum(1 << b for b in bits) for bits in masks)))
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    hot = rows.groupBy("t", "key").count().filter(F.col("count") > cell)
    hot = written(hot.select("t", "key", F.ceil(F.col("count") / cell).cast("int").alias("chunks")), "hot-buckets")
    rows = rows.join(hot, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.select("t", "key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    rows = rows.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    parts = max(2 * spark.sparkContext.defaultParallelism, n * len(masks) // 500_000)
    rows = rows.repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return rows.mapInArrow(_links(radius, extra), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id reachable over links of at most radius bits."""
    prints = written(with_fingerprints(docs, id_col, text_col, words), "fingerprints")
    each = prints.groupBy("fp").agg(F.min("id").alias("least"))
    label = components(links(each.select("fp"), radius))
    each = each.join(label, each.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    each = written(each, "labels")
    named = each.groupBy("label").agg(F.min("least").alias("component_id"))
    of = each.join(named, "label").select(F.col("fp").alias("of"), "component_id")
    return prints.join(of, F.col("fp") == F.col("of")).select("id", "fp", "component_id")


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several hash functions over the same shingles; the 0-th is the hash itself."""
    if k == 0 or not len(hashes):
        return hashes
    with np.errstate(over="ignore"):
        h = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each of BANDS groups of GROUP minima of the shingle hashes under multiplications; two texts share
    a key where all its minima are equal, each with the chance of their Jaccard likeness."""
    least = np.full(len(MULTIPLIERS), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 2048):
            np.minimum(least, (hashes[k : k + 2048, None] * MULTIPLIERS[None, :]).min(axis=0), out=least)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for part in least.reshape(BANDS, GROUP).T:
            keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys


def sketch(hashes: np.ndarray) -> bytes:
    """BINS numbers of four bits: shingle hashes are dealt to bins, and a bin keeps a number from 1 to 15 of its smallest
    one; 0 stands for an empty bin. Small sets are sketched nearly whole, large ones by BINS shingles."""
    out = np.zeros(BINS, np.uint8)
    if len(hashes):
        h = np.sort(remixed(hashes, 64))
        bins, first = np.unique(h >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
        out[bins.astype(np.int64)] = 1 + ((h[first] & np.uint64(0xFFFFFFFF)) % np.uint64(15)).astype(np.uint8)
    return (out[::2] | out[1::2] << 4).tobytes()


def estimated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The likeness of sketches, row by row: the share of equal bins among those not empty in both, less chance hits."""
    out = np.empty(len(x))
    for k in range(0, len(x), 1 << 14):
        a, b = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
        filled = hit = both = 0
        for shift in (0, 4):
            p, o = (a >> shift) & 15, (b >> shift) & 15
            filled = filled + ((p | o) != 0).sum(axis=1)
            two = (p != 0) & (o != 0)
            both, hit = both + two.sum(axis=1), hit + (two & (p == o)).sum(axis=1)
        out[k : k + (1 << 14)] = (hit - (both - hit) / 14) / np.maximum(filled, 1)
    return out


def _classes(words: int, prints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                fps, keys, sketches, same = [], [], [], []
                for x in part.column(2).cast(pa.binary()).to_pylist():
                    flat, spans = shingle_spans(x, words)
                    hashes = np.array([xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in spans], np.uint64)
                    same.append(xxhash.xxh64_intdigest(flat, 1))
                    fps.append([majority(remixed(hashes, j)) for j in range(prints)])
                    keys.append(band_keys(hashes))
                    sketches.append(sketch(hashes))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(same) + 1, BANDS), pa.int32()), pa.array(np.array(keys, np.uint64).reshape(-1).view(np.int64)))
                cols = [part.column(0), part.column(1), pa.array(np.array(same, np.uint64).view(np.int64)), keys]
                cols.append(pa.array([np.array(f, "<u8").tobytes() + s for f, s in zip(fps, sketches)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "hash", "node", "keys", "marks"])

    return run


def close_pairs(marks: list[np.ndarray], labels: list[np.ndarray], prints: int, least: float, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, likeness as estimated) of the pairs of a cell (one side, or two) of different labels whose fingerprints
    are within the radius and whose sketches are alike; with `most`, as many for each row, the likest first."""
    left, right = marks[0], marks[-1]
    fps = [np.ascontiguousarray(m[:, : 8 * prints]).view("<u8") for m in (left, right)]
    planes = planes_of(fps[1])
    found = []
    for k in range(0, len(left), QUERIES):
        n = len(right) if len(marks) > 1 else min(len(left), k + QUERIES)
        row, col = near(fps[0][k : k + QUERIES], planes[:, : -(-n // 64)], n, FAR * prints)
        row = row + k
        keep = labels[0][row] != labels[-1][col]
        if len(marks) == 1:
            keep &= row > col
        row, col = row[keep], col[keep]
        like = np.empty(len(row))
        for a in range(0, len(row), 1 << 14):
            like[a : a + (1 << 14)] = estimated(left[row[a : a + (1 << 14)], 8 * prints :], right[col[a : a + (1 << 14)], 8 * prints :])
        keep = like >= least - MARGIN
        found.append((row[keep], col[keep], like[keep]))
    row, col, like = (np.concatenate(x) for x in zip(*found))
    return _first_of_each(row, col, like, most)


def small_pairs(cell: np.ndarray, label: np.ndarray, marks: np.ndarray, prints: int, least: float, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """close_pairs of many small cells at once: rows that stand d apart are compared for all cells together."""
    fps, found = np.ascontiguousarray(marks[:, : 8 * prints]).view("<u8"), []
    for d in range(1, len(cell)):
        row = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(row):
            break
        row = row[label[row] != label[row + d]]
        row = row[np.bitwise_count(fps[row] ^ fps[row + d]).sum(axis=1, dtype=np.int64) <= FAR * prints]
        found.append((row, row + d, estimated(marks[row, 8 * prints :], marks[row + d, 8 * prints :])))
    row, col, like = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    keep = like >= least - MARGIN
    return _first_of_each(row[keep], col[keep], like[keep], most)


def _first_of_each(row: np.ndarray, col: np.ndarray, like: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that are among the `most` likest of one of their ends; all without `most`."""
    if most is None or not len(row):
        return row, col, like
    keep = np.zeros(len(row), bool)
    for of in (row, col):
        order = np.lexsort((-like, of))
        of = of[order]
        keep[order[np.arange(len(of)) - np.searchsorted(of, of) < most]] = True
    return row[keep], col[keep], like[keep]


def _cells(prints: int, least: float, most: int | None):
    """Rows (key, i, j, side, node, label, marks) come sorted by cell (key, i, j). Cells of under SMALL_CELL rows are
    compared many at once, larger ones by bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, small, n_small = None, [], [], 0

        def given(a, b, like):
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(like)], names=["a", "b", "like"])

        def flush_small():
            nonlocal small, n_small
            if small:
                node, label, marks = (np.concatenate([p[c] for p in small]) for c in range(3))
                of = np.repeat(np.arange(len(small)), [len(p[0]) for p in small])
                small, n_small = [], 0
                row, col, like = small_pairs(of, label, marks, prints, least, most)
                if len(row):
                    yield given(node[row], node[col], like)

        def flush():
            nonlocal n_small
            sides = []
            for s in (0, 1):
                parts = [h for h in held if h[0] == s]
                if parts:
                    sides.append(tuple(np.concatenate([p[c] for p in parts]) for c in (1, 2, 3)))
            if not sides or (len(sides) == 1 and (cell[1] != cell[2] or len(sides[0][0]) < 2)):
                return
            if len(sides) == 1 and len(sides[0][0]) < SMALL_CELL:
                small.append(sides[0])
                n_small += len(sides[0][0])
                if n_small >= 1 << 13:
                    yield from flush_small()
                return
            row, col, like = close_pairs([s[2] for s in sides], [s[1] for s in sides], prints, least, most)
            if len(row):
                yield given(sides[0][0][row], sides[-1][0][col], like)

        for batch in batches:
            key, i, j, side, node, label = (batch.column(k).to_numpy() for k in range(6))
            if not len(key):
                continue
            marks = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(key), -1)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(key)]):
                now = (key[a], i[a], j[a])
                if now != cell:
                    yield from flush()
                    cell, held = now, []
                held.append((side[a], node[a:b], label[a:b], marks[a:b]))
        yield from flush()
        yield from flush_small()

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 128) for whole in batches for k in range(0, whole.num_rows, 128)):
            sets = [np.unique(shingle_hashes(x, words)).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "likeness"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are at least so alike."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")
    return written(both.mapInArrow(_alike, "a long, b long, likeness double").filter(F.col("likeness") >= least).select("a", "b"), "linked-pairs")


def _likest(pairs: DataFrame, most: int, by: str) -> DataFrame:
    """Of each node the `most` pairs first by the column; a node has at most BANDS times `most` a cell."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("n"), "a", "b", by)  # in one pass: a union would make the pairs twice
    top = sides.groupBy("n").agg(F.slice(F.sort_array(F.collect_set(F.struct(by, "a", "b")), False), 1, most).alias("t"))
    return top.select(F.explode("t").alias("t")).select("t.a", "t.b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, prints: int = 3) -> DataFrame:
    """(id, hash, keeper) of every document but the first of its group, by id and then by the hash of its text. Groups are
    linked by a Jaccard likeness of at least `least` over shingles of `words` words.

    Documents of one normalised text are a node. Nodes that share one of BANDS keys of minima are a bucket. First each
    node is checked against the smallest of the buckets in which it meets that one most often, so that most groups join at
    once. The buckets that still hold several components are cut into cells of PAIR_CELL nodes a side; a cell compares
    SimHash bit planes, `prints` words a node, with carry-save counters, and then sketches. Pairs over the radius of FAR
    bits a word, or estimated at more than MARGIN under `least`, are left out; the others are checked on whole
    shingle sets: ROUNDS times, first the likest of each node, at last all pairs still in different components.

    Rows of equal id and text are one document; of an id with several texts each is a document. Null ids come last. Texts
    without any word are one group. Nodes are named by 64 bits of their text. An empty table has no rows."""
    last = F.lit(2**63 - 1)
    slim = docs.select(F.coalesce(q(id_col).cast("long"), last).alias("id"), F.xxhash64(F.coalesce(q(text_col), F.lit(""))).alias("hash"), F.coalesce(q(text_col), F.lit("")).alias("text"))
    rows = written(slim.mapInArrow(_classes(words, prints), "id long, hash long, node long, keys array<long>, marks binary"), "shingle-classes")
    classes = rows.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("least"), F.any_value("keys").alias("keys"), F.any_value("marks").alias("marks"))
    classes = written(classes, "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "node")
    buckets = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1"), "buckets")
    shared = written(keyed.join(buckets, "key"), "shared-keys")
    nodes = written(classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "least", "marks"), "nodes")
    texts = slim.join(nodes.select("node", "least.id", "least.hash"), ["id", "hash"]).select("node", "text")
    sets = texts.mapInArrow(_shingle_sets(words), "node long, shingles binary").groupBy("node").agg(F.any_value("shingles").alias("shingles"))
    sets = written(sets, "shingle-sets")

    star = shared.filter("node <> first").groupBy(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).agg(F.count("*").alias("times"))
    tried = written(_likest(star, 2, "times"), "candidate-pairs")
    linked = _verified(tried, sets, least)
    for most in ROUNDS:
        label = written(components(linked), "near-labels")
        now = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "marks")
        at = shared.select("key", "node").join(now.select("node", "label"), "node")
        open_ = at.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
        open_ = written(open_.select("key", F.ceil(F.col("n") / PAIR_CELL).cast("int").alias("chunks")), "open-buckets")
        at = at.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        at = at.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        at = at.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
        at = written(at, "cell-rows")
        parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, at.count() // 100_000)
        cells = at.join(now, "node").select("key", "i", "j", "side", "node", "label", "marks").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        pairs = cells.mapInArrow(_cells(prints, least, most), "a long, b long, like double")
        pairs = _likest(pairs, most, "like") if most else pairs.select("a", "b").distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "candidate-pairs")
        tried, linked = tried.union(pairs), linked.union(_verified(pairs, sets, least))
    label = components(linked)
    of = classes.join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    of = written(of, "groups")
    keepers = of.join(written(of.groupBy("label").agg(F.min("least").alias("keep")), "keepers"), "label").select("node", F.col("keep.id").alias("keeper"), F.col("keep.hash").alias("kept"))
    gone = rows.select("id", "hash", "node").distinct().join(keepers, "node").filter((F.col("id") != F.col("keeper")) | (F.col("hash") != F.col("kept")))
    return gone.select(F.nullif("id", last).alias("id"), "hash", F.nullif("keeper", last).alias("keeper"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near_duplicates; of rows equal in id and text one stays."""
    gone = written(near_duplicates(docs, id_col, text_col, words, least).select("id", "hash"), "near-copies")
    id_, hash_ = q(id_col).cast("long"), F.xxhash64(F.coalesce(q(text_col), F.lit("")))
    a, b = fresh("near_id", docs), fresh("near_hash", docs)
    gone = gone.toDF(a, b)
    kept = docs.join(gone, id_.eqNullSafe(q(a)) & (hash_ == q(b)), "left_anti")
    again = written(docs.groupBy(id_.alias(a), hash_.alias(b)).count().filter("count > 1").select(a, b), "repeated-rows")
    once = kept.join(again, id_.eqNullSafe(q(a)) & (hash_ == q(b)), "left_anti")
    more = kept.join(again, id_.eqNullSafe(q(a)) & (hash_ == q(b))).groupBy(a, b).agg(F.any_value(F.struct(*(q(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))).alias("row"))
    return once.union(more.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns))))
