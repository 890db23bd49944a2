"""Ranked lexical search, impact-ordered and score at a time.

Documents are read once: a row a document with its number of words and the words that some query may hold. Which
those are is told by a bitmap of FILTER_BITS bits (a megabyte, whatever the number of queries) over the queries'
words; its false positives go at the exact join with the queries' words. A posting's impact is the whole number
that it adds to a score. Postings are dealt by document over shards of about SHARD postings and queries over
blocks of about BLOCK words; a shard meets a block in one task of a cogroup. There the postings of a word are
grouped by exact impact in descending order. A query takes its groups from the highest impact down, all words at
a time, into one accumulator a document, and stops when what is left proves the rest: no document can still
gain more than the sum of its words' next impacts, so once that is under the kth score, only documents whose
accumulator comes within that sum of it remain. The scores of these few are completed by looking up their other
postings. A pilot over one shard gives every query a floor for the others. Each shard returns at most k
documents a query, and the best of them are ranked.

Cases: a null or empty text, and one without words, is no document and gets no rank, and as a query gets no row.
Each row is a document, also if it repeats an id or has none: equal scores rank by id (null last), then by row.
Each query row is ranked by itself, also if it repeats an id. Texts of any length are read whole. Empty tables
give no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import q, written
from gleaner.llm.terms import LETTERS_DIGITS, Words

FILTER_BITS = 1 << 23
SHARD = 1 << 20
BLOCK = 1 << 18
FALL = 0.6  # a round takes the groups whose impact is this share of the highest left, or more
SPARE = 8  # times k: so many candidates are completed at most, unless nothing is left to read
COUNTED = "key long, id long, n long, terms array<string>, counts array<long>"


def _count_words(bits: bytes | None):
    """Rows (id, text as bytes) -> COUNTED; with `bits` only words that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, key = Words(LETTERS_DIGITS), TaskContext.get().partitionId() << 40
        mask = len(bits) * 8 - 1 if bits else 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: Counter = Counter()
                n = 0
                for part in words.lists(text):
                    n += len(part)
                    seen.update(part)
                if not n:
                    continue
                if bits:
                    at = [(t, zlib.crc32(t) & mask) for t in seen]
                    kept = [t for t, h in at if bits[h >> 3] >> (h & 7) & 1]
                else:
                    kept = list(seen)
                for col, v in zip(out, (key, i, n, kept, [seen[t] for t in kept])):
                    col.append(v)
                key += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            cols = [pa.array(c, t) for c, t in zip(out, kinds)]
            cols[3] = cols[3].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "n", "terms", "counts"])

    return run


def count_words(rows: DataFrame, id_col: str, text_col: str, bits: bytes | None = None) -> DataFrame:
    """One row a row with at least one word: a key of its own, its id, number of words, distinct words and their counts."""
    slim = rows.select(q(id_col).cast("long").alias("id"), F.encode(q(text_col), "UTF-8").alias("text"))
    return slim.mapInArrow(_count_words(bits), COUNTED)


def word_filter(terms: DataFrame) -> bytes:
    """A bitmap over crc32 of the words: at most FILTER_BITS bits reach the driver, in pieces of 4 KB."""
    at = (F.crc32("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("at")  # Spark's positions count from one
    parts = terms.select(at).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in parts.collect():
        out[(r.b - 1) * len(r.bits) : r.b * len(r.bits)] = r.bits
    return bytes(out)


class Postings:
    """The postings of a shard, grouped by word and, within a word, by exact impact in descending order."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((-impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.n_docs = int(doc.max()) + 1 if len(doc) else 0
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.impact[1:] != self.impact[:-1])
        self.start = np.append(np.flatnonzero(new), len(term))  # of each group
        self.fall = -self.impact[self.start[:-1]]  # of each group, ascending within a word
        self.terms, first = np.unique(term[self.start[:-1]], return_index=True)
        self.span = np.append(first, len(self.fall))  # of each word, in groups
        word = np.repeat(np.arange(len(self.terms)), np.diff(self.start[self.span]))
        at = np.argsort(self.doc * max(1, len(self.terms)) + word, kind="stable")  # by document and word, for completion
        self.pair, self.pair_impact = (self.doc * max(1, len(self.terms)) + word)[at], self.impact[at]

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) that hold the k best, none under the floor, and how many postings were read."""
        at = np.searchsorted(self.terms, terms)
        word = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        place, end = self.span[word].copy(), self.span[word + 1]
        score, read, floor = np.zeros(self.n_docs, np.int64), 0, max(1, floor)
        some = np.arange(0)
        while True:
            head = np.where(place < end, -self.fall[np.minimum(place, len(self.fall) - 1)], 0) if len(word) else place
            rest = int(head.sum())
            kth = int(np.partition(score, -k)[-k]) if self.n_docs > k else 0
            bar = max(floor, kth)
            if rest < bar or not rest:
                some = np.flatnonzero(score + rest >= bar)
                if len(some) <= SPARE * k or not rest:
                    break
            least = max(1, int(head.max() * FALL))
            for w in np.flatnonzero(head >= least):
                a, b = place[w], place[w] + np.searchsorted(self.fall[place[w] : end[w]], -least, side="right")
                a, b, place[w] = self.start[a], self.start[b], b
                score[self.doc[a:b]] += self.impact[a:b]  # a document stands once in a word's postings
                read += int(b - a)
        exact = score[some]
        if rest and len(some):
            pair = some[:, None] * len(self.terms) + word[None, :]
            found = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            exact = np.where(self.pair[found] == pair, self.pair_impact[found], 0).sum(axis=1)
        good = exact >= floor
        return some[good], exact[good], read


FOUND = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("read", pa.int64())])


def _meet(k: int):
    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if postings.num_rows and queries.num_rows:
            keys, first, doc = np.unique(postings["key"].to_numpy(), return_index=True, return_inverse=True)
            held = Postings(doc, postings["term"].to_numpy(), postings["impact"].to_numpy())
            ids = postings["id"].take(pa.array(first)).to_pylist()
            for query, item, floor, terms in zip(*(queries[c].to_pylist() for c in ("query", "item_id", "floor", "terms"))):
                some, score, read = held.search(np.array(terms, np.int64), k, floor or 0)
                rows = sorted((-s, ids[d] is None, ids[d] or 0, int(keys[d]), d) for d, s in zip(some.tolist(), score.tolist()))[:k]
                for s, _, _, key, d in rows:
                    for col, v in zip(out, (query, item, key, ids[d], -s, read)):
                        col.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, FOUND.types)], schema=FOUND)

    return run


def _length_norm(n: str, docs: int, words: int) -> Column:
    """The share of a document's length in its impacts, in whole numbers wide enough for any corpus."""
    return F.expr(f"50L + ((50 * cast({n} as decimal(16,0)) * cast({docs} as decimal(16,0))) div cast({max(1, words)} as decimal(20,0)))")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, and `read`, how many postings of its
    shard the query read for it."""
    asked = written(count_words(queries, item_col, query_col), "asked")
    vocabulary = written(asked.select(F.explode("terms").alias("term")).distinct(), "vocabulary").withColumn("number", F.monotonically_increasing_id())
    counted = written(count_words(docs, id_col, text_col, word_filter(vocabulary)), "counted")
    n_docs, n_words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.expr(f"cast(floor(1000 * ln((2D * {n_docs} + 2) / (2D * df + 1))) as bigint)")
    weights = written(vocabulary.join(held, "term").select("term", "number", "df", weight.alias("weight")), "weights")
    n_postings = weights.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    uses = asked.select("key", F.explode("terms").alias("term")).join(weights, "term").groupBy("key").agg(F.collect_list("number").alias("terms"))
    uses = written(asked.select(F.col("key"), F.col("id").alias("item_id")).join(uses, "key").withColumnRenamed("key", "query"), "uses")
    n_uses = uses.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    shards, blocks = max(1, math.ceil(n_postings / SHARD)), max(1, math.ceil(n_uses / BLOCK))

    def impacts(only: Column | None = None) -> DataFrame:
        rows = counted.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        rows = (rows if only is None else rows.filter(only)).select("shard", "key", "id", _length_norm("n", n_docs, n_words).alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        rows = rows.select("shard", "key", "id", "m", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf")).join(weights.select("term", "number", "weight"), "term")
        gain = F.expr("weight * ((1000000000L * tf) div (1000L * tf + 20L * m))")
        return rows.select("shard", F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"), "key", "id", F.col("number").alias("term"), gain.alias("impact")).filter("impact > 0")

    def best(postings: DataFrame, asked: DataFrame, to: int) -> DataFrame:
        block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
        asked = asked.select(F.explode(F.expr(f"sequence(0, {to - 1})")).alias("shard"), block, "query", "item_id", "floor", "terms")
        met = postings.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_meet(k), "query long, item_id long, key long, doc_id long, score long, read long")
        order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    floors = None
    if shards > 1:
        pilot = best(impacts(F.col("shard") == 0), uses.withColumn("floor", F.lit(0).cast("long")), 1)
        floors = written(pilot.filter(F.col("rank") == k).select("query", F.col("score").alias("floor")), "floors")
    uses = uses.withColumn("floor", F.lit(0).cast("long")) if floors is None else uses.join(floors, "query", "left")
    return best(impacts(), uses, shards).select("item_id", "rank", "doc_id", "score", "read")
