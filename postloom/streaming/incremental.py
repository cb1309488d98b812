"""Incremental processing with Structured Streaming.

Sources are folders of files; every query is run with ``availableNow``, so that a call takes in what has arrived since the
last call and ends. Progress and state live in the checkpoint folder: a call that is cut off is taken up again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_new(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def run_now(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, sink: str | None = None, mode: str = "append") -> None:
    """Processes all that has arrived: into a Parquet sink, or by a function of (batch, number)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", sink).start()
    q.awaitTermination()


def first_seen(stream: DataFrame, key: str, stamp: str | None = None, late: str = "30 days") -> DataFrame:
    """The first row of every key. With a stamp, keys are forgotten once ``late`` has passed (bounded state)."""
    if stamp:
        return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def window_counts(stream: DataFrame, stamp: str, width: str, by: list[str], late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per window and group; rows later than ``late`` are left out."""
    w = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    return stream.withWatermark(stamp, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(stream: DataFrame, stamp: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(stamp, late).groupBy(key, F.session_window(stamp, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def upsert_once(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch function that appends unseen keys only, under its batch number: a batch that comes again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        new = batch.dropDuplicates([key])
        if fs.exists(path):
            done = spark.read.parquet(target).where(F.col("batch_no") != number)
            new = new.join(done.select(key), key, "left_anti")
        new.withColumn("batch_no", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(target)

    return run


def mark_complete(spark: SparkSession, path: str, partition: str, n: int) -> None:
    """Notes that a partition is done, as one row of a control table."""
    spark.createDataFrame([(partition, n)], "partition string, n long").write.mode("append").json(path)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """The partitions noted as done; unreadable notes count as not done."""
    return spark.read.schema("partition string, n long").option("mode", "DROPMALFORMED").json(path).where("partition IS NOT NULL").groupBy("partition").agg(F.max("n").alias("n"))
