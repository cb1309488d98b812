"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.io import table
from postloom.llm.mixing import mixture, shares
from postloom.session import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_docs(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _docs(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return shares(mixture(docs, targets), docs, targets)


QUERIES = {"p9_mixture": mixed, "p9_shares": reached}
SQL: dict[str, str] = {}
