"""Packing by cutting-stock column generation: whole documents in ranked patterns, next to no padding, few cuts.

Every document becomes token ids and an end id. Full pieces of `capacity` ids are sequences by themselves; what
remains, under `capacity`, is one piece of the histogram. The tokenising pass also numbers the pieces of each length
within its task, so a piece's rank among all of its length is that number plus the pieces of earlier tasks: sums over
(length, task), no sort. Only the histogram (at most `capacity` rows) reaches the driver, where `stock.plan` turns it
into patterns, and the plan, of the same order whatever the corpus, goes to the tasks. There a piece's sequence and
offset follow from its length and rank alone.

The few documents that the plan cuts (those of the least filled sequences, about one in a hundred) are read once
more for the checksums of their pieces: a bitmap of at most FILTER_BITS bits over the checksums of their texts picks
them out of the documents, a join on SHA-256 confirms. `docs` must therefore give the same texts when read again.

Cases: a null or empty text is a document of the end id alone. Each row is a document, also if it repeats a doc_id or
has none, or repeats a text. Texts of any length are tokenised whole. An empty table gives no pieces. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import q, written
from gleaner.llm.packing import _encoder
from gleaner.llm.stock import GAP, Places, plan

FILTER_BITS = 1 << 27
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, text_key binary, task int, nth long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CUT = "doc_id long, start long, doc_tokens long, text_key binary, cuts array<struct<length:long,sequence_id:long,offset:long>>"


def _kinds(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    pairs = [x.split() for x in schema.split(", ")]
    return [a for a, _ in pairs], [kinds[b] for _, b in pairs]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names, kinds = _kinds(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _pieces(path: str, ranks: str | None, pattern: str | None, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = _encoder(path, ranks, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out: list[list] = [[] for _ in range(8)]
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text or ""
                    ids, key = np.array([*encode(text), end_id], "<u4"), hashlib.sha256(text.encode()).digest()
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        for col, v in zip(out, (i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), key, task, nth[len(piece)])):
                            col.append(v)
                        nth[len(piece)] += 1
                yield _batch(PIECES, out)

    return run


def _place(places: Places):
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, text_key, rank) -> PLACED and cuts; a piece that is cut has
    no checksum yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_kind = pa.list_(pa.struct([("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]))
        names = [*_kinds(PLACED)[0], "text_key", "cuts"]
        for batch in batches:
            length = batch.column(2).to_numpy()
            sequence, offset = places.of(length, batch.column(6).to_numpy())
            cuts = [None if s >= 0 else [(n, 2 * t, o) for n, t, o in places.cuts(at, x)] for s, at, x in zip(sequence.tolist(), offset.tolist(), length.tolist())]
            cuts = pa.array([None if c is None else [dict(zip(("length", "sequence_id", "offset"), x)) for x in c] for c in cuts], cut_kind)
            cols = [*(batch.column(k) for k in range(5)), pa.array(2 * sequence), pa.array(offset), batch.column(5), cuts]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _cut(path: str, ranks: str | None, pattern: str | None, end_id: int):
    """Rows (doc_id, start, doc_tokens, cuts, text) -> PLACED, a row a cut piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, ranks, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, start, tokens, cuts, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*encode(text), end_id], "<u4")
                for c in cuts:
                    n = c["length"]
                    for col, v in zip(out, (i, start, n, zlib.crc32(ids[start : start + n].tobytes()), tokens, c["sequence_id"], c["offset"])):
                        col.append(v)
                    start += n
            yield _batch(PLACED, out)

    return run


def _picked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of these keys, once each: picked out by a bitmap before they are joined."""
    at = lambda key: (F.crc32(key).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("at")
    parts = keys.select(at("text_key")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    bits = {r.b: bytes(r.bits) for r in parts.collect()}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats = [zlib.crc32(k) & (FILTER_BITS - 1) for k in batch.column(1).to_pylist()]
            good = [(b := bits.get((a >> 15) + 1)) is not None and b[(a & 32767) >> 3] >> (a & 7) & 1 == 1 for a in ats]
            if any(good):
                yield batch.filter(pa.array(good))

    return found.mapInArrow(pick, "text string, text_key binary").join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 0, capacity: int = 1024,
    width: int = 4, gap: float = GAP, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `tokenizer` is the path of a
    tokenizers file; `capacity` is a power of two and a multiple of `width`, and full pieces get odd sequence ids."""
    if capacity & (capacity - 1) or capacity % width:
        raise ValueError("capacity must be a power of two and a multiple of width")
    slim = docs.select(q(id_col).cast("long").alias("id"), q(text_col).alias("text"))
    pieces = written(slim.mapInArrow(_pieces(tokenizer, ranks, pattern, end_id, capacity), PIECES), "pieces")
    whole = pieces.filter(F.col("length") == capacity)
    whole = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr("2 * (shiftleft(cast(task as bigint), 36) + nth) + 1").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    rest = pieces.filter(F.col("length") < capacity)
    tallies = rest.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tallies = written(tallies.select("length", "task", "n", before.alias("before")), "tallies")
    histogram = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity - 1 rows
    if not histogram:
        return whole
    places = Places(plan(histogram, capacity, width, gap))
    ranked = rest.join(tallies.select("length", "task", "before"), ["length", "task"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_key", (F.col("before") + F.col("nth")).alias("rank"))
    placed = written(ranked.mapInArrow(_place(places), PLACED + ", " + CUT[CUT.index("text_key") :]), "placed")
    cut = placed.filter("cuts is not null").select("doc_id", "start", "doc_tokens", "text_key", "cuts")
    texts = written(_picked(slim, cut.select("text_key").distinct()), "cut-texts")
    cut = cut.join(texts, "text_key").select("doc_id", "start", "doc_tokens", "cuts", "text")
    placed = placed.filter("cuts is null").select(whole.columns)
    return whole.union(placed).union(cut.mapInArrow(_cut(tokenizer, ranks, pattern, end_id), PLACED))
