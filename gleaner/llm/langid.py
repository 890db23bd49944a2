"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 3-grams of the lower-cased text with every run of other characters
than letters as one space: sub-linear term counts times inverse document frequencies, scaled to
length one. The document frequencies are counted in Spark over every document that may be learned
from. The weights are fitted with follow-the-regularised-leader (per-coordinate steps, L1 and L2
penalties) on a sample of at most MAX_FIT rows, drawn by a hash; this bound is the `max_fit`
parameter. They are fitted in one task, which gets the counts of the sampled rows' n-grams, at most
BUCKETS a row; the driver gets the model. Of more than MAX_CLASSES labels the most frequent are learned (`max_classes`): a model is
as large as its classes. A quarter of the sample is kept from the fit to calibrate the temperature of the
softmax. Prediction reads whole texts and nothing else.

Cases: a text that is null or without any letter gets `und` and score 0, and so does every text
if there is nothing to learn from. Rows with a null label are not learned from. The model (classes
x BUCKETS weights) is what travels to the executors; it does not grow with the data. Rows are judged one by one,
also if they repeat an id; an empty table stays empty. lang_pred and score replace columns so called, whatever their case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import bounded_batches, fresh, q, without

BUCKETS = 1 << 15
MAX_FIT = 6000
MAX_CLASSES = 500
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point: whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count) of a text's n-grams; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = letter | np.concatenate(([True], letter[:-1]))  # of a run of others, one
    code = np.concatenate(([np.uint64(32)], code[keep], [np.uint64(32)]))
    found = []
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.zeros(len(code), np.uint64)
        for n in (1, 2, 3):
            h = (h[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * mix
            h ^= h >> np.uint64(29)
            found.append(h & np.uint64(BUCKETS - 1))
    count = np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at]


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray  # BUCKETS
    weights: np.ndarray  # BUCKETS x classes
    bias: np.ndarray  # classes
    temperature: float

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        got = grams(text)
        return None if got is None else self.scaled(*got)

    def scaled(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def scores(self, text: str | None) -> np.ndarray | None:
        got = self.features(text)
        if got is None or not self.classes:
            return None
        at, x = got
        return softmax(((x[:, None] * self.weights[at]).sum(axis=0) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        p = self.scores(text)
        if p is None:
            return UNKNOWN, 0.0
        k = int(p.argmax())
        return self.classes[k], min(1.0, float(p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 7) -> Model:
    """Follow-the-regularised-leader with elastic-net penalties on (text or its grams, label) rows, then the temperature."""
    classes = sorted({label for _, label in rows})
    model = Model(classes, idf, np.zeros((BUCKETS, len(classes))), np.zeros(len(classes)), 1.0)
    data = [(f, classes.index(label)) for x, label in rows if (f := model.scaled(*x) if isinstance(x, tuple) else model.features(x)) is not None]
    if not data or len(classes) < 2:
        return model
    order = np.random.default_rng(seed).permutation(len(data))
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    z, n = np.zeros((BUCKETS + 1, len(classes))), np.zeros((BUCKETS + 1, len(classes)))

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in used:
            (at, x), y = data[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = softmax((x[:, None] * w).sum(axis=0))
            p[y] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    whole = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = whole[:BUCKETS], whole[BUCKETS]
    if len(held):
        raw = np.stack([(x[:, None] * model.weights[at]).sum(axis=0) + model.bias for (at, x), _ in (data[k] for k in held)])
        truth = np.array([data[k][1] for k in held])

        def loss(log_t: float) -> float:
            p = softmax(raw / np.exp(log_t))[np.arange(len(truth)), truth]
            return float(-np.log(np.maximum(p, 1e-12)).mean()) + 1e-4 * log_t * log_t

        lo, hi = -4.0, 3.0
        for _ in range(50):  # golden section
            a, b = hi - 0.618034 * (hi - lo), lo + 0.618034 * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        model.temperature = float(np.exp((lo + hi) / 2))
    return model


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            if (got := grams(x)) is not None:
                seen[got[0]] += 1
                docs += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], docs), pa.int64())], names=["bucket", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, buckets, counts) of (text, label): what the fit needs of a text."""
    for batch in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
        found = [(label, got) for x, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (got := grams(x)) is not None]
        cols = [[label for label, _ in found], [got[0].astype("<u2").tobytes() for _, got in found], [got[1].astype("<u4").tobytes() for _, got in found]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["lang", "at", "n"])


def _fitted(idf: np.ndarray):
    """The rows of the sample, in order, -> the model: it is fitted in a task, so the driver holds the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(((np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)), label))
        if rows:
            m = fit(rows, idf)
            cols = [pa.array([m.classes], pa.list_(pa.string())), pa.array([m.weights.astype("<f8").tobytes()], pa.binary()), pa.array([m.bias.astype("<f8").tobytes()], pa.binary()), pa.array([m.temperature])]
            yield pa.RecordBatch.from_arrays(cols, names=["classes", "weights", "bias", "temperature"])

    return run


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", max_fit: int = MAX_FIT, max_classes: int = MAX_CLASSES) -> Model:
    """A model from the rows of docs where `learn` holds and the label is not null."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(learn & q(lang_col).isNotNull()).select(q(text_col).alias("text"), q(lang_col).cast("string").alias("lang"))
    counted = rows.select("text").mapInArrow(_document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = {r.bucket: r.n for r in counted}  # at most BUCKETS + 1 rows
    n = counts.pop(-1, 0)
    frequency = np.zeros(BUCKETS)
    frequency[list(counts)] = list(counts.values())
    idf = np.log((1 + n) / (1 + frequency)) + 1
    by_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_classes).collect()}
    if not by_lang:
        return fit([], idf)
    share = max(1, max_fit // len(by_lang))
    draw = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    chance = F.create_map(*(F.lit(x) for k, v in by_lang.items() for x in (k, min(1.0, 2.0 * share / v))))
    picked = rows.filter(draw < F.coalesce(F.try_element_at(chance, F.col("lang")), F.lit(0.0))).select("text", "lang", F.xxhash64("text", F.lit(5)).alias("place"))
    last = picked.select("place").orderBy("place").limit(max_fit).agg(F.max("place")).first()[0]
    if last is None:
        return fit([], idf)
    sample = picked.filter(F.col("place") <= last).select("text", "lang").mapInArrow(_counted, "lang string, at binary, n binary")
    sample = sample.orderBy(F.xxhash64("at", "n"), "lang").limit(max_fit)  # equal texts share a place
    made = sample.mapInArrow(_fitted(idf), "classes array<string>, weights binary, bias binary, temperature double").first()  # of one task, as it follows a limit
    if made is None:
        return fit([], idf)
    bias = np.frombuffer(made.bias, "<f8")
    return Model(made.classes, idf, np.frombuffer(made.weights, "<f8").reshape(BUCKETS, len(bias)), bias, made.temperature)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            names = [batch.schema.field(k).name for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (replacing columns of these names)."""
    docs = without(docs, "lang_pred", "score")
    text = q(text_col).alias(fresh("text", docs))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    flat = docs.select("*", text).toDF(*(f"c{k}" for k in range(len(docs.columns) + 1)))
    inner = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)] + schema.fields[-2:])
    return flat.mapInArrow(_predict(shared), inner).toDF(*schema.names)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(q(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
