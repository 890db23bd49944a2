"""Exact top-k search by KD-trees, one per shard.

Vectors are turned into integers and dealt over shards of about SHARD rows, once: the table is
written sorted by shard and only read afterwards, block after block of queries. A task builds a tree
over each of its shards (or what a file split leaves of one) by median splits of the widest
dimension, with the tight box of every node; that takes about a hundredth of the search of a block.
Queries come in blocks of at most BLOCK, the only thing that is broadcast (BLOCK vectors, a fixed
size). A query walks a tree best first: nodes in descending order of the highest inner product their
box allows, until that bound falls under the kth score found so far. The kth score is propagated: a
pilot search in one shard gives every query a floor before the other shards are entered, and within
a task it rises from shard to shard. Shards return at most k candidates a query, and only those that
reach the floor; a partial and a final rank merge them.

Products are exact: vectors whose components stay under sqrt(2**53 / dimensions) are multiplied as
doubles, which hold all sums; larger ones, rare in practice, are compared with everything as whole
numbers of any size, without a tree. A score outside of 64 bits ranks by its true value and is
returned as the nearest 64-bit number.

Cases: vectors that are null or hold null or non-finite components, and those without an id, take no
part. Vectors of other lengths than the query's are no candidates for it. Equal scores rank by the
smaller id. A row is never its own candidate; rows repeating an id are queries and candidates each for
itself, so such a query id has several rows of each rank. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import q, written

SHARD = 8192
BLOCK = 8192
LEAF = 256


class Tree:
    """A KD-tree over the rows of a matrix: boxes of the nodes, rows in the order of the leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.kids = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, up, side = todo.pop()
            part = rows[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.kids.append([-1, -1])
            if up >= 0:
                self.kids[up][side] = node
            wide = int((high - low).argmax()) if part.shape[1] else 0
            if b - a > leaf and part.shape[1] and high[wide] > low[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that each node's box allows each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, floor: float) -> list[tuple[float, int, int]]:
        """(score, -id, -row) of up to k rows with the best scores, none under the floor, own row left out."""
        best: list[tuple[float, int, int]] = []
        todo = [(-bound[0], 0)]
        while todo:
            most, node = heapq.heappop(todo)
            if -most < floor:
                break
            kids = self.kids[node]
            if kids[0] >= 0:
                for kid in kids:
                    if bound[kid] >= floor:
                        heapq.heappush(todo, (-bound[kid], kid))
                continue
            a, b = self.span[node]
            score = self.rows[a:b] @ query
            at = np.flatnonzero(score >= floor)
            if len(at) > 4 * k:  # the k best of a leaf, all that tie with the kth included
                at = at[score[at] >= np.partition(score[at], len(at) - k - 1)[len(at) - k - 1]]
            for s, (i, row) in zip(score[at].tolist(), self.ids[a:b][at].tolist()):
                if row == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i, -row))
                elif (s, -i, -row) > best[0]:
                    heapq.heapreplace(best, (s, -i, -row))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def limit(dimensions: int) -> float:
    """Components up to this size have inner products that doubles hold exactly."""
    return math.sqrt(2**53 / max(1, dimensions))


def whole(rows: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale x) as doubles, which rows are small enough to be multiplied as such)."""
    with np.errstate(over="ignore"):
        out = np.floor(rows * float(scale))
    return out, (np.abs(out) <= limit(rows.shape[1])).all(axis=1) if rows.shape[1] else np.ones(len(rows), bool)


def large(row: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as numbers of any size; from 2**53 on a double is whole before it is scaled."""
    return np.array([int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in row.tolist()], object)


def _matrices(batch: pa.RecordBatch, at: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, row numbers, matrix) of a batch's vectors, by their length."""
    col = batch.column(at)
    lengths = np.asarray(col.value_lengths())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out.append((int(d), rows, flat[(starts[rows][:, None] + np.arange(d)[None, :])].astype(np.float64)))
    return out


def _clamped(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _search(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; blocks: {dimensions: (rows, ids, vectors, floors)}."""
        blocks = {d: (rows, ids, *whole(x, scale), x, floors.copy()) for d, (rows, ids, x, floors) in shared.value.items()}
        shard, held = None, {}

        def given(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array([_clamped(s) for s in cols[4]], pa.int64()), pa.array([str(int(s)) if abs(s) >= 2**62 else None for s in cols[4]], pa.string())], names=["query_row", "query_id", "vec_id", "vec_row", "score", "beyond"])

        def flush():
            for d, parts in held.items():
                if d not in blocks:
                    continue
                rows, ids, queries, fits, raw, floors = blocks[d]
                marks, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                numbers, small = whole(matrix, scale)
                tree = Tree(marks[small], numbers[small]) if small.any() else None
                huge = [(marks[j], large(matrix[j], scale)) for j in np.flatnonzero(~small)]
                out: list[tuple] = []
                for a in range(0, len(ids), 512):
                    bounds = tree.bounds(np.where(fits[a : a + 512, None], queries[a : a + 512], 0)) if tree else None
                    for j in range(a, min(a + 512, len(ids))):
                        best, least = [], float(floors[j])  # compared with whole numbers of any size
                        if fits[j]:
                            if tree and bounds[j - a][0] >= floors[j]:
                                best = tree.search(int(rows[j]), queries[j], bounds[j - a], k, floors[j])
                            others = huge
                        else:
                            others = [(m, large(x, scale)) for m, x in zip(marks, matrix)]
                        if others:
                            query = large(raw[j], scale)
                            best = heapq.nlargest(k, best + [(s, -int(i), -int(r)) for (i, r), x in others if r != rows[j] and (s := int(x @ query) if d else 0) >= least])
                        if len(best) == k:
                            floors[j] = max(least, float(max(-(2**900), min(min(best)[0], 2**900))))
                        out += [(int(rows[j]), int(ids[j]), -i, -r, s) for s, i, r in best]
                    if out:
                        yield given(out)
                        out = []

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                if b == a:
                    continue
                if of[a] != shard:
                    yield from flush()
                    shard, held = of[a], {}
                part = batch.slice(a, b - a)
                marks = np.stack([part.column(1).to_numpy(), part.column(2).to_numpy()], axis=1)
                for d, rows, matrix in _matrices(part, 3):
                    held.setdefault(d, []).append((marks[rows], matrix))
        yield from flush()

    return run


SCHEMA = "query_row long, query_id long, vec_id long, vec_row long, score long, beyond string"


def search(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of all vectors the k of highest integer inner product for each one where `asked` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(q(id_col).cast("long").alias("id"), q(vec_col).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("ask")).filter("id is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = written(rows, "vectors").withColumn("row", F.monotonically_increasing_id())  # by file and place in it: the same in every attempt
    n = rows.count()
    shards = max(1, math.ceil(n / shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    rows = written(rows.select("shard", "id", "row", "v", "ask").repartition(min(shards, 4096), "shard").sortWithinPartitions("shard"), "shards")
    queries = rows.filter("ask").select("id", "row", "v")
    n_blocks = max(1, math.ceil(queries.count() / (block * 3 // 4)))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_blocks)).cast("int"))
    if n_blocks > 1:
        queries = written(queries.repartition(min(n_blocks, 4096), "block"), "query-blocks")
    table = rows.select("shard", "id", "row", "v")
    out = None
    for b in range(n_blocks):
        by: dict[int, list] = {}
        for r in queries.filter(F.col("block") == b).toLocalIterator():
            by.setdefault(len(r.v), []).append((r.row, r.id, r.v))
        now = {d: (np.array([x[0] for x in part], np.int64), np.array([x[1] for x in part], np.int64), np.array([x[2] for x in part], np.float64).reshape(len(part), d), np.full(len(part), -np.inf)) for d, part in by.items()}
        shared = spark.sparkContext.broadcast(now)
        found = written(table.filter("shard = 0").mapInArrow(_search(shared, k, scale), SCHEMA), "pilot")
        shared.destroy()
        if shards > 1:
            top = found.filter("beyond is null").groupBy("query_row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k)
            floor = {r.query_row: float(r.floor) for r in top.collect()}  # at most BLOCK
            now = {d: (at, ids, m, np.array([floor.get(int(i), -np.inf) for i in at])) for d, (at, ids, m, _) in now.items()}
            shared = spark.sparkContext.broadcast(now)
            found = found.union(written(table.filter("shard > 0").mapInArrow(_search(shared, k, scale), SCHEMA), "candidates"))
            shared.destroy()
        out = found if out is None else out.union(found)
    below, digits = F.startswith("beyond", F.lit("-")), F.ltrim("beyond", F.lit("-"))  # scores past 62 bits: by sign, length and digits
    size = F.coalesce(F.when(below, -F.length(digits)).otherwise(F.length(digits)), F.lit(0))
    order = [F.desc(size), F.desc(F.when(~below, digits)), F.asc(F.when(below, digits)), F.desc("score"), F.col("vec_id"), F.col("vec_row")]
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(*order))
    return out.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
