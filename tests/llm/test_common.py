import os
import time

from gleaner.llm import common
from pyspark.sql import functions as F


def test_written_tables_and_their_removal(spark):
    df = common.written(spark.range(5), "five")
    top = f"{common.shared_dir(spark)}/{spark.sparkContext.applicationId}"
    assert df.count() == 5 and any(x.startswith("five-") for x in os.listdir(top.removeprefix("file://")))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= common.BATCH_ROWS


def test_columns_by_exact_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "Text", "x`y"])
    assert common.without(df, "text").columns == ["a.b", "x`y"]
    assert df.select(common.q("a.b"), common.q("x`y")).first() == (1, 3)


def test_written_leaves_no_shuffle_files(spark):
    """What a write shuffled is gone behind it, though the session lives on."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(x) for x in disk.getAllBlocks().mkString(" ").split(" ") if x.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(common.CLEANUP, "false")
    out = common.written(spark.range(100_000).repartition(3, "id").groupBy((F.col("id") % 10).alias("k")).count(), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 10 and spark.conf.get(common.CLEANUP, "false") == setting
