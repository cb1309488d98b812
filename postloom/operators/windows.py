"""Windows over time. Anchors are the greatest instant of the data, not the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY = 86400


def per_day(df: DataFrame, day: Column, by: list[str], value: Column) -> DataFrame:
    """Rows and mean value per day and group."""
    return df.where(day.isNotNull()).groupBy(*by, day.alias("day")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def every_day(daily: DataFrame, by: list[str]) -> DataFrame:
    """daily with all days between a group's first and last; the added ones have n 0 and no mean."""
    span = daily.groupBy(*by).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(*by, F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    return spine.join(daily, [*by, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rolling_mean(dense: DataFrame, by: list[str], days: int) -> DataFrame:
    """dense with ``rolling``: the mean of the daily means of the last ``days`` days, days without one left out."""
    w = W.partitionBy(*by).orderBy("day").rowsBetween(-(days - 1), 0)
    return dense.withColumn("rolling", F.avg("mean").over(w))


def quiet_spells(dense: DataFrame, by: list[str], least_days: int = 5, part: float = 0.25) -> DataFrame:
    """Runs of at least ``least_days`` days whose volume is under max(1, part x upper median of the days with any)."""
    from postloom.functions.numbers import upper_median

    limit = dense.groupBy(*by).agg(F.greatest(F.lit(1.0), part * F.coalesce(upper_median(F.collect_list(F.when(F.col("n") > 0, F.col("n")))), F.lit(0))).alias("limit"))
    low = dense.join(limit, by).where(F.col("n") < F.col("limit"))
    run = F.date_sub("day", F.row_number().over(W.partitionBy(*by).orderBy("day")))
    spells = low.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"))
    return spells.where(F.col("n_days") >= least_days).drop("_run")


def anchored(df: DataFrame, epoch: str, by: list[str]) -> DataFrame:
    """df with ``age``: seconds before the greatest instant of its group (of all rows where ``by`` is empty)."""
    top = df.groupBy(*by).agg(F.max(epoch).alias("_top"))
    if by:
        return df.join(top, by).withColumn("age", F.col("_top") - F.col(epoch)).drop("_top")
    # One row: the anchor of the whole table.
    return df.join(F.broadcast(top)).withColumn("age", F.col("_top") - F.col(epoch)).drop("_top")


def window_delta(df: DataFrame, epoch: str, value: Column, by: list[str], days: int = 7, least: int = 20) -> DataFrame:
    """Mean of the last ``days`` against the ``days`` before; the delta is null where either has fewer than ``least`` values."""
    a = anchored(df, epoch, by)
    now, then = F.col("age") < days * DAY, (F.col("age") >= days * DAY) & (F.col("age") < 2 * days * DAY)
    agg = a.groupBy(*by).agg(
        F.avg(F.when(now, value)).alias("mean_now"), F.avg(F.when(then, value)).alias("mean_before"),
        F.count(F.when(now, value)).alias("n_now"), F.count(F.when(then, value)).alias("n_before"),
    )
    return agg.withColumn("delta", F.when((F.col("n_now") >= least) & (F.col("n_before") >= least), F.col("mean_now") - F.col("mean_before")))


def concentrated(counts: DataFrame, by: list[str], bucket: str, n: str, part: float = 0.7) -> DataFrame:
    """The fewest buckets of a group that hold ``part`` of its rows, largest first (ties: earlier bucket first)."""
    order = W.partitionBy(*by).orderBy(F.desc(n), bucket)
    total = F.sum(n).over(W.partitionBy(*by))
    before = F.coalesce(F.sum(n).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_before", before).withColumn("_total", total).where(F.col("_before") < part * F.col("_total")).drop("_before", "_total")
