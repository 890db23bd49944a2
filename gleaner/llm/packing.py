"""Best-fit packing by the linear grouping scheme.

Every document becomes token ids and an end id; a longer one is cut into pieces of `capacity`
whose first may be shorter. Pieces of exactly `capacity` are sequences by themselves. The others
are dealt evenly over shards of about SHARD pieces, and each shard is packed in one task:
large lengths are sorted into groups of equal cardinality and rounded up to the largest of their
group; the linear program over configurations of these few sizes is solved by column generation;
its whole part is filled with actual pieces, each slot taking the largest piece that fits the room
its configuration leaves; then small pieces, and what the whole part left over, go best-fit into
the gaps. A shard is a few thousand pieces whatever the corpus, so memory and the linear program
stay bounded, and dealing costs at most about one part-filled sequence a shard.

Cases: a null or empty text is a document of the end id alone. Each row is a document, also if it
repeats a doc_id or has none. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import q, written

SHARD = 32768
GROUPS = 128
SMALL = 4  # a small piece is under capacity / SMALL
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _encoder(path: str, ranks: str | None, pattern: str | None):
    """text -> ids as the tokenizer file at `path` gives them; `ranks`, the same vocabulary for the faster
    library, serves every text that holds no special token."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    slow = lambda x: exact.encode(x, add_special_tokens=False).ids
    if not ranks:
        return slow
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(x: str) -> list[int]:
        if SPECIAL in x or len(x) > 400_000:
            return slow(x)
        return fast.encode_ordinary(x)

    return encode


def _pieces(path: str, ranks: str | None, pattern: str | None, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out: list[list] = [[], [], [], [], [], []]
                for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(x or ""), end_id], "<u4")
                    start, piece = 0, 0
                    size = len(ids) % capacity or capacity
                    while start < len(ids):
                        raw = ids[start : start + size].tobytes()
                        for col, v in zip(out, (i, piece, start, size, zlib.crc32(raw), raw)):
                            col.append(v)
                        start, piece, size = start + size, piece + 1, capacity
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(out[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _best_config(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most: the best of one more piece, again
    and again, for every room at once; few pieces fit, so the levels are few."""
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fit, at = room >= 0, np.maximum(room, 0)
    value, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        gain = np.where(fit, value[at] + worth[:, None], 0.0)
        pick = gain.argmax(axis=0)
        value = gain[pick, np.arange(capacity + 1)]
        picks.append(np.where(value > 0, pick, -1))
    config, c = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            config[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(config @ worth), config


def solve_configs(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """(configuration, how often) of the linear program: cover the demand with the fewest configurations."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for step in range(rounds):
        worth = inverse.sum(axis=0)  # dual prices: every configuration costs one sequence
        value, config = _best_config(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-4:
            break
        move = inverse @ config
        ok = move > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        basis[:, out] = config
        x = x - t * move
        x[out] = t
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
    return [(basis[:, k].astype(int), max(0.0, float(x[k]))) for k in range(n)]


class _Held:
    """What is left of each length (or room), with the largest under a bound or smallest over it at hand."""

    def __init__(self, top: int):
        self.of: list[list[int]] = [[] for _ in range(top + 1)]
        self.mask = 0

    def put(self, size: int, what: int) -> None:
        self.of[size].append(what)
        self.mask |= 1 << size

    def _take(self, size: int) -> tuple[int, int]:
        got = self.of[size].pop()
        if not self.of[size]:
            self.mask &= ~(1 << size)
        return size, got

    def at_most(self, bound: int) -> tuple[int, int] | None:
        under = self.mask & ((1 << bound + 1) - 1)
        return self._take(under.bit_length() - 1) if under else None

    def at_least(self, bound: int) -> tuple[int, int] | None:
        over = self.mask >> bound
        return self._take(bound + (over & -over).bit_length() - 1) if over else None


def pack(lengths: np.ndarray, capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence of each piece, its offset there, how many sequences); lengths are 1 to capacity."""
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []

    def place(k: int, size: int, s: int) -> None:
        seq[k], off[k] = s, used[s]
        used[s] += size

    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] * SMALL >= capacity]
    left = _Held(capacity)
    for k in order.tolist():
        left.put(int(lengths[k]), k)
    if len(large):
        each = max(1, math.ceil(len(large) / groups))
        tops = lengths[large[::each]]  # of groups of equal cardinality, in descending order
        rounded = np.repeat(tops, each)[: len(large)]
        sizes, demand = np.unique(rounded, return_counts=True)
        for config, times in sorted(solve_configs(sizes, demand.astype(float), capacity), key=lambda c: -int((c[0] * sizes).sum())):
            slots = [int(s) for s, m in zip(sizes[::-1], config[::-1]) for _ in range(m)]
            for _ in range(int(times + 1e-6)):
                free, s = capacity - sum(slots), None
                for slot in slots:
                    got = left.at_most(slot + free)  # room saved by smaller pieces is open to the next slots
                    if got is None:
                        free += slot
                        continue
                    if s is None:
                        s = len(used)
                        used.append(0)
                    place(got[1], got[0], s)
                    free += slot - got[0]
    gaps = _Held(capacity)
    for s, u in enumerate(used):
        gaps.put(capacity - u, s)
    while (got := left.at_most(capacity)) is not None:
        size, k = got
        hole = gaps.at_least(size)
        s = hole[1] if hole else len(used)
        if not hole:
            used.append(0)
        place(k, size, s)
        gaps.put(capacity - used[s], s)
    return seq, off, len(used)


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        seq, off, _ = pack(table.column("length").to_numpy(), capacity)
        base = int(table.column("__shard")[0].as_py()) << 32
        table = table.drop_columns(["__shard"])
        return table.append_column("sequence_id", pa.array(2 * (base + seq), pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 2, capacity: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, with_ids: bool = False,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit,
    with_ids), sequence_id, offset. `tokenizer` is the path of a tokenizers file."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    slim = docs.select(q(id_col).cast("long").alias("id"), q(text_col).alias("text"))
    pieces = written(slim.mapInArrow(_pieces(tokenizer, ranks, pattern, end_id, capacity, with_ids), schema), "pieces")
    pieces = pieces.withColumn("__row", F.monotonically_increasing_id())  # by file and place in it: the same in every attempt
    whole = pieces.filter(F.col("length") == capacity).select("*", (2 * F.col("__row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("__row")
    rest = pieces.filter(F.col("length") < capacity)
    shards = max(1, math.ceil(rest.count() / shard))
    rest = rest.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards)).cast("long")).drop("__row")
    packed = rest.groupBy("__shard").applyInArrow(_packed(capacity), schema + ", sequence_id long, offset long")
    return whole.union(packed)
