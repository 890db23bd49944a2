"""A keyed table of files that micro-batches write: the last write of a key wins when it is read.

The folder holds `batch=<n>` for every micro-batch and `base=<n>` for what the batches up to n came to. A batch is
written to a folder of its own beside them and moved into place whole, so a writer that dies leaves nothing that is
read, and a batch that is sent again replaces itself. A base is made the same way and readers take the latest that is
in place with the batches after it, so those that run meanwhile lose nothing; `vacuum` deletes what no new reader
takes, once those that have started are done.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BATCH, BASE = "batch", "base"


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    place, files = _files(spark, path)
    if not files.exists(place):
        return []
    found = (re.fullmatch(rf"{kind}=(\d+)", s.getPath().getName()) for s in files.listStatus(place))
    return sorted(int(m[1]) for m in found if m)


def _put(rows: DataFrame, path: str, name: str) -> None:
    """Writes rows beside and moves them into place, in place of what stands there."""
    spark, aside = rows.sparkSession, f"{path}/_{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    source, files = _files(spark, aside)
    target, _ = _files(spark, f"{path}/{name}")
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{name} could not be moved into place")


def _last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    best = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__place", F.row_number().over(best)).filter("__place = 1").drop("__place")


def write_batch(rows: DataFrame, batch: int, path: str, key: str, order: list[str]) -> None:
    """Puts the last write of each key of a micro-batch in place; sent again it changes nothing. One that a base holds
    already is not taken again."""
    bases = _numbers(rows.sparkSession, path, BASE)
    if not bases or batch > bases[-1]:
        _put(_last(rows, key, order), path, f"{BATCH}={batch}")


def read_latest(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame | None:
    """The last write of each key by `order`, of equal ones that of the later batch; null for a table without any batch."""
    bases = _numbers(spark, path, BASE)
    parts = [(bases[-1], f"{path}/{BASE}={bases[-1]}")] if bases else []
    parts += [(n, f"{path}/{BATCH}={n}") for n in _numbers(spark, path, BATCH) if not bases or n > bases[-1]]
    if not parts:
        return None
    number = F.regexp_extract(F.col("_metadata.file_path"), rf"(?:{BATCH}|{BASE})=(\d+)/[^/]*$", 1).cast("long")
    rows = spark.read.option("mergeSchema", True).parquet(*(p for _, p in parts)).withColumn("__batch", number)
    return _last(rows, key, [*order, "__batch"]).drop("__batch")


def compact(spark: SparkSession, path: str, key: str, order: list[str]) -> int | None:
    """Makes a base of all batches in place; its number."""
    batches = _numbers(spark, path, BATCH) + _numbers(spark, path, BASE)
    if not batches:
        return None
    _put(read_latest(spark, path, key, order), path, f"{BASE}={max(batches)}")
    return max(batches)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes batches and bases that the latest base holds, and what writers that died left."""
    bases = _numbers(spark, path, BASE)
    place, files = _files(spark, path)
    for status in files.listStatus(place) if files.exists(place) else []:
        m = re.fullmatch(rf"({BATCH}|{BASE})=(\d+)", status.getPath().getName())
        old = bool(m and bases) and (int(m[2]) < bases[-1] or (m[1] == BATCH and int(m[2]) == bases[-1]))
        if old or status.getPath().getName().startswith("_"):
            files.delete(status.getPath(), True)


def upsert_stream(writes: DataFrame, path: str, checkpoint: str, key: str, order: list[str]):
    """A stream of writes into the table."""
    put = lambda rows, batch: write_batch(rows, batch, path, key, order)
    return writes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
