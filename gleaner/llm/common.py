"""Shared pieces: the folder that all executors see, written cuts of lineage, column helpers."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.staging import BATCH_ROWS, bounded_batches  # noqa: F401

_own_dirs: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FEW_ROWS, TASK_ROWS = 200_000, 20_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset and driver and executors are one process (as in tests) a
    folder of our own; on a cluster that would be another folder on every machine, so it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="gleaner-")
    return _own_dirs[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and lost executors cost
    nothing that was written. Its file size is known to the planner, so a later join broadcasts
    it only if it is under spark.sql.autoBroadcastJoinThreshold and shuffles it otherwise. The shuffle files of the write
    are deleted at its end, as nothing reads them again."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many short rows at most: up to FEW_ROWS of them its last step has a task for TASK_ROWS each, as empty tasks take longer
    than their rows where spark.sql.shuffle.partitions is high; over that nothing changes."""
    return df.coalesce(max(2, math.ceil(rows / TASK_ROWS))) if rows <= FEW_ROWS else df


def fresh(prefix: str, *frames: DataFrame) -> str:
    """A column name with this prefix that none of the frames has, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = prefix
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less columns of these names, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*(q(c) for c in df.columns if c.lower() not in gone))


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def discard(spark: SparkSession) -> None:
    """Deletes all that `written` left for this application; frames that still read it break."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
