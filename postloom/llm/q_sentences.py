"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.io import table
from postloom.llm.sentences import learn, sentence_ends
from postloom.session import spread


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return sentence_ends(docs, learn(docs))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends(spark, sf_dir).select("doc_id", "end_pos")


def per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, also of those without any."""
    n = ends(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"))
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return docs.join(n, "doc_id", "left").select("doc_id", "lang", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"))


QUERIES = {"p10_found": found, "p10_per_document": per_document}
SQL: dict[str, str] = {}
