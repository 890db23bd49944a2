"""Line dedup with two Bloom filters.

A first pass over the documents sets two filters: a line's hash enters `once` when a document
holds it, and `twice` when `once` already had it. The partial filters of all tasks meet as
segments: `once` by OR, `twice` by OR together with the AND of the `once` parts, so no repeated
line is missed. A second pass sends only lines that `twice` knows to the shuffle; there they are
counted by a SHA-256 of their key, so that false positives fall out, and the last holder is
chosen. Everything else stays where it was read.

The filter takes BITS_PER_LINE bits a line up to `max_filter_bits` (MAX_FILTER_BITS, 64 MB, the
bound of what is broadcast), and as many hashes as are best for the bits a line that there are.
Beyond the bound it lets more lines through to the exact count, never fewer: of the lines seen once
0.2 % at 16 bits a line, 15 % at 4, 39 % at 2, and all in the end. A line that passes is 40 bytes of
shuffle and summed in the tasks, so that the worst case, every line, is still far less than the texts.

Cases: a null or empty text is one empty line. Each row is a document: rows that repeat a doc_id
count one by one and share their fate. A null doc_id ranks below all others. Keys shorter than
`min_chars` code points never drop. Output columns n_lines and n_dropped replace columns of the
same names. An empty table stays empty. Texts of any length are split whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import bounded_batches, fresh, q, without, written

BITS_PER_LINE = 16
MIN_FILTER_BITS = 1 << 20
MAX_FILTER_BITS = 1 << 29
MAX_HASHES = 4
SEGMENT = 1 << 16  # bytes of a filter that travel as one row
WHITE = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return line.strip(WHITE).lower()


def eligible(text: bytes, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that are long enough to drop."""
    keys = {line_key(x) for x in text.split(b"\n")}
    return {k for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)}


def hashes_for(bits: int, lines: int) -> int:
    """How many hashes a line let the fewest others pass: bits a line times ln 2, MAX_HASHES at most."""
    return max(1, min(MAX_HASHES, round(0.693 * bits / max(1, lines))))


def places(hashes: np.ndarray, bits: int, n: int = MAX_HASHES) -> np.ndarray:
    """The n bit numbers of each hash, one row a hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(n, dtype=np.uint64)) & np.uint64(bits - 1)


def holds(filt: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filt[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(filt: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filt, (at >> np.uint64(3)).astype(np.int64).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _partial_filters(bits: int, k_hashes: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            found = [xxhash.xxh64_intdigest(k) for x in _texts(batch, "text") for k in eligible(x, min_chars)]
            hashes, n = np.unique(np.array(found, np.uint64), return_counts=True)
            at = places(hashes, bits, k_hashes)
            put(twice, at[(n > 1) | holds(once, at)])
            put(once, at)
        for k in range(0, bits // 8, SEGMENT):
            a, b = once[k : k + SEGMENT], twice[k : k + SEGMENT]
            if a.any():
                yield pa.RecordBatch.from_pydict({"seg": pa.array([k // SEGMENT], pa.int32()), "once": [a.tobytes()], "twice": [b.tobytes()]})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the rows of each segment as they stream in; memory is that of the segments, not the rows."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(row[k], np.uint8) for k in ("once", "twice"))
            if row["seg"] in held:
                a0, b0 = held[row["seg"]]
                a, b = a | a0, b | b0 | (a & a0)
            held[row["seg"]] = (a, b)
    for seg, (_, b) in held.items():
        if b.any():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "twice": [b.tobytes()]})


def repeat_filter(docs: DataFrame, min_chars: int, max_filter_bits: int = MAX_FILTER_BITS) -> tuple[int, int, bytes]:
    """(bits, hashes, the merged twice-seen filter over all lines of `text`, at most max_filter_bits / 8 bytes)."""
    text = F.coalesce(q("text"), F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(max_filter_bits, max(MIN_FILTER_BITS, 1 << max(0, BITS_PER_LINE * int(lines) - 1).bit_length()))
    k_hashes = hashes_for(bits, int(lines))
    parts = docs.mapInArrow(_partial_filters(bits, k_hashes, min_chars), "seg int, once binary, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in parts.repartition(docs.sparkSession.sparkContext.defaultParallelism, "seg").mapInArrow(_merged, "seg int, twice binary").toLocalIterator():
        whole[row["seg"] * SEGMENT : row["seg"] * SEGMENT + len(row["twice"])] = np.frombuffer(row["twice"], np.uint8)
    return bits, k_hashes, whole.tobytes()


def _suspects(shared, bits: int, k_hashes: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for i, x in zip(batch.column("id").to_pylist(), _texts(batch, "text")):
                for k in eligible(x, min_chars):
                    ids.append(i)
                    keys.append(k)
            if keys:
                seen = holds(twice, places(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64), bits, k_hashes))
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_pydict({"id": pa.array([ids[i] for i in at], pa.int64()), "key": pa.array([hashlib.sha256(keys[i]).digest() for i in at], pa.binary())})

    return run


def _rewritten(text_at: int, names: list[str], schema: pa.Schema, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for x, gone in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = (x or b"").split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    gone, left = set(gone), []
                    for line in lines:
                        k = line_key(line)
                        if len(k) < min_chars or hashlib.sha256(k).digest() not in gone:
                            left.append(line)
                    n_dropped.append(len(lines) - len(left))
                    kept.append(b"\n".join(left).decode())
                else:
                    n_dropped.append(0)
                    kept.append(None if x is None else x.decode())
            cols = [pa.array(kept, schema.field(k).type) if k == text_at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """docs with repeated lines dropped from text_col, and n_lines (before) and n_dropped added.

    A key of at least min_chars code points found in at least min_docs documents loses its lines
    everywhere except in the documents of the largest id that holds it. A null text stays null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, "n_lines", "n_dropped")
    ids = F.coalesce(q(id_col).cast("long"), F.lit(NO_ID))
    slim = docs.select(ids.alias("id"), q(text_col).alias("text"))
    bits, k_hashes, twice = repeat_filter(slim.select("text"), min_chars, max_filter_bits)
    shared = spark.sparkContext.broadcast(twice)
    suspects = written(slim.mapInArrow(_suspects(shared, bits, k_hashes, min_chars), "id long, key binary"), "suspect-lines")
    shared.destroy()
    confirmed = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)
    confirmed = written(confirmed, "repeated-lines")  # a join of its own: Spark can split a hot key's rows there
    gone = suspects.join(confirmed, "key").filter(F.col("id") < F.col("keeper"))
    gone_id, gone_keys = fresh("gone_id", docs), fresh("gone_keys", docs)
    gone = written(gone.groupBy("id").agg(F.collect_set("key").alias("keys")), "dropped-lines").toDF(gone_id, gone_keys)
    out_schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    joined = docs.join(gone, ids == q(gone_id), "left").drop(gone_id)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    from pyspark.sql.pandas.types import to_arrow_schema

    joined = joined.toDF(*(f"c{k}" for k in range(len(joined.columns))))  # names with dots do not get past mapInArrow
    return joined.mapInArrow(_rewritten(at, out_schema.names, to_arrow_schema(out_schema), min_chars), out_schema)
