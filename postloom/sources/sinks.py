"""Writing results. Spark's committer makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "json") -> None:
    """One folder per value of ``by``, replaced as a whole; values without rows leave no folder."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def append_new(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> int:
    """Appends the rows whose key the target does not hold yet (all, if there is no target), and says how many."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    new = df.dropDuplicates([key])
    if exists:
        new = new.join(spark.read.format(fmt).schema(df.schema).load(path).select(key), key, "left_anti").select(*df.columns)
    observation = Observation("appended")
    new.observe(observation, F.count(F.lit(1)).alias("n")).write.mode("append").format(fmt).save(path)
    return int(observation.get["n"])


def split_rejects(df: DataFrame, reason: str, text: str, chars: int = 120) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and those with one beside the head of their text."""
    kept = df.where(F.col(reason).isNull()).drop(reason)
    return kept, df.where(F.col(reason).isNotNull()).withColumn("text_preview", F.substring(text, 1, chars))


def report_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])
