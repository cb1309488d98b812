"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.io import table
from postloom.llm.languages import build_filter, count_agreeing, count_words, detect, label_set
from postloom.session import materialise, spread

MIN_POST_WORDS = 4


def _detected(spark: SparkSession, sf_dir: str, with_segments: bool = False) -> DataFrame:
    """Posts with label and detected languages. The reference is the documents with one known language and, once a filter
    made of them agrees with their label, the posts themselves."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id").select("text", "lang")
    posts = spread(table(spark, sf_dir, "golden_input", "row_id", "text", "lang_label"), "row_id")
    posts = posts.select("row_id", "text", label_set(F.col("lang_label")).alias("label"), _n_words().alias("n_words"))
    words = materialise(count_words(docs), "reference-words")
    built = build_filter(words.unionByName(count_agreeing(posts, build_filter(words), "text", "label")))
    return detect(posts.withColumn("label", F.array_join("label", "+")), built, "text", ["row_id", "label", "n_words"], with_segments)


def _n_words():
    plain = F.regexp_replace("text", r"#\S+", " ")
    return F.regexp_count(plain, F.lit(r"\S*[\p{L}\p{N}]\S*"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detected(spark, sf_dir).where((F.col("n_words") >= MIN_POST_WORDS) & (F.col("langs") != ""))
    wrong = d.where(F.col("label").isNull() | (F.col("label") != F.col("langs")))
    return wrong.select("row_id", F.explode(F.split("langs", r"\+")).alias("lang"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with its languages and confidence."""
    return _detected(spark, sf_dir).select("row_id", "langs", F.round("confidence", 4).alias("confidence"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every post with its language and confidence."""
    d = _detected(spark, sf_dir, True).select("row_id", F.posexplode("segments").alias("pos", "s"))
    return d.select("row_id", (F.col("pos") + 1).alias("segment_no"), "s.begin", "s.end", "s.lang", F.round("s.confidence", 4).alias("confidence"))


QUERIES = {"p5_found": found, "p5_posts": posts, "p5_segments": segments}
SQL: dict[str, str] = {}
