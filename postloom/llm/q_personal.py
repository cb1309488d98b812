"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.io import table
from postloom.llm.personal import corpus_lexicon, draw_sample, find_personal, learn, redact
from postloom.session import spread


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    posts = table(spark, sf_dir, "golden_input", "row_id", "text")
    given = {r.given_name for r in table(spark, sf_dir, "given_names").where("given_name IS NOT NULL").toLocalIterator()}  # a fixed list
    return spread(posts, "row_id"), learn(draw_sample(posts, "row_id", "text"), given, lex=corpus_lexicon(posts, "text", given))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, model = _model(spark, sf_dir)
    # A piece that stands twice in a text is one case; both are found in the same task.
    return find_personal(posts, model, "row_id", "text").select("row_id", "kind", "found_text").distinct()


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, model = _model(spark, sf_dir)
    return redact(posts, model, "row_id", "text")


QUERIES = {"p7_found": found, "p7_redacted": redacted}
SQL: dict[str, str] = {}
