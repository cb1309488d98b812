"""Joins of posts, assignments, labels and scores, and the checks between them.

All are equi-joins that Spark plans by the size of their sides; nothing is broadcast by hand. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_label(assigned: DataFrame, labels: DataFrame, on: list[str], outlier: str, default: Column | str) -> DataFrame:
    """assigned with ``topic_label``: the outlier label for topic -1, else the label, else the default."""
    other = F.lit(default) if isinstance(default, str) else default
    j = assigned.join(labels.select(*on, F.col("label").alias("_label")), on, "left")
    return j.withColumn("topic_label", F.when(F.col("topic_id") == -1, F.lit(outlier)).otherwise(F.coalesce("_label", other))).drop("_label")


def reconcile(expected: DataFrame, got: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key of either side with ``status``: matched, missing (expected only) or extra (got only), and ``n_got``.

    Of several answers to one key the last in the given order counts; the answer's other columns are kept.
    """
    from pyspark.sql import Window as W

    last = got.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).withColumn("n_got", F.count("*").over(W.partitionBy(key))).where("_k = 1").drop("_k")
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    both = e.join(last, key, "full")
    status = F.when(F.col("_e").isNull(), "extra").when(F.col("n_got").isNull(), "missing").otherwise("matched")
    return both.withColumn("status", status).withColumn("n_got", F.coalesce("n_got", F.lit(0))).drop("_e")


def invariants(posts: DataFrame, assigned: DataFrame, labels: DataFrame, key: str, topic: list[str]) -> DataFrame:
    """``problem`` and ``n``: keys assigned without a post, posts without an assignment, keys assigned more than once, topics without a label."""
    p, a = posts.select(key).where(F.col(key).isNotNull()).distinct(), assigned.select(key)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    parts = [
        count("extra", a.distinct().join(p, key, "left_anti")),
        count("missing", p.join(a.distinct(), key, "left_anti")),
        count("repeated", a.groupBy(key).count().where("count > 1")),
        count("unlabelled", assigned.where("topic_id <> -1").select(*topic).distinct().join(labels.select(*topic).distinct(), topic, "left_anti")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
