"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.io import table
from postloom.llm.canonical import canonical, reader, same_reading_pairs
from postloom.session import spread


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spread(table(spark, sf_dir, "golden_input", "row_id", "text"), "row_id")
    pairs = same_reading_pairs(posts, "row_id", "text")
    return pairs.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with its canonical and reader's form."""
    posts = spread(table(spark, sf_dir, "golden_input", "row_id", "text"), "row_id")
    return posts.select("row_id", canonical("text").alias("canonical_text"), reader("text").alias("reader_text"))


QUERIES = {"p1_found": found, "p1_forms": forms}
SQL: dict[str, str] = {}
