"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.io import table
from postloom.llm.terms import Changes, TermCounts, changes, new_counts

TEXT, WORD = "golden_input.text", "topic_keywords.word"
RECORD = ["run_id", "topic_id"]


def _texts(rows: DataFrame) -> Changes:
    return Changes(TEXT, rows, F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))


def _words(rows: DataFrame) -> Changes:
    return Changes(WORD, rows, F.array_compact(F.array(F.regexp_replace(F.lower("word"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))), RECORD)


def _load(spark: SparkSession, sf_dir: str) -> TermCounts:
    """Both fields in two arrivals: the earlier half of the posts and the upper ranks of each topic, then, as a change set
    merged into those counts, the rest."""
    posts = table(spark, sf_dir, "golden_input", "row_id", "text").withColumn("sign", F.lit(1))
    words = table(spark, sf_dir, "topic_keywords", *RECORD, "kw_rank", "word").withColumn("sign", F.lit(1))
    middle = posts.agg(F.expr("(min(row_id) + max(row_id)) div 2")).first()[0] or 0
    state = new_counts(spark)
    upper = F.coalesce(F.col("kw_rank") <= 5, F.lit(False))
    state.merge(_texts(posts.where(F.col("row_id") <= middle)), _words(words.where(upper)))
    return state.merge(_texts(posts.where(F.col("row_id") > middle)), _words(words.where(~upper)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir).marks().select("field_name", "term", "mark")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir).counts().select("field_name", "term", "n_occurrences", "n_records")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after additions, changes and deletions. The first state holds each post as first collected and without its
    last line, the documents among the posts, and the upper keyword ranks of each topic twice; the second is that of the
    tables. Between the two the folder is opened anew."""
    posts = table(spark, sf_dir, "golden_input", "row_id", "post_id", "text")
    words = table(spark, sf_dir, "topic_keywords", *RECORD, "kw_rank", "word")
    first = posts.withColumn("k", F.row_number().over(W.partitionBy("post_id").orderBy("row_id"))).where("k = 1")
    drafts = first.select("row_id", F.regexp_replace("text", r"\n[^\n]*$", "").alias("text"))
    gone = table(spark, sf_dir, "documents", "doc_id", "text").select((-F.col("doc_id") - 1).alias("row_id"), "text")
    upper = words.where("kw_rank <= 5")
    states = [(drafts.unionByName(gone), upper.unionByName(upper)), (posts, words)]
    path = new_counts(spark).path
    for (old_posts, old_words), (new_posts, new_words) in zip([(posts.limit(0), words.limit(0)), states[0]], states, strict=True):
        TermCounts(spark, path).merge(
            _texts(changes(old_posts, new_posts, "row_id", "text")), _words(changes(old_words, new_words, *RECORD, "kw_rank", "word"))
        )
    return TermCounts(spark, path).counts().select("field_name", "term", "n_occurrences", "n_records")


QUERIES = {"p4_found": found, "p4_counts": counts, "p4_incremental": incremental}

_TERMS = """
WITH t AS (
  SELECT 'golden_input.text' AS field_name, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term, row_id::VARCHAR AS record FROM golden_input
  UNION ALL
  SELECT 'topic_keywords.word', regexp_replace(lower(word), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), run_id || '/' || topic_id FROM topic_keywords WHERE word IS NOT NULL),
c AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT record) AS n_records FROM t GROUP BY ALL),
s AS (SELECT 'golden_input.text' AS field_name, count(*) AS n FROM golden_input UNION ALL SELECT 'topic_keywords.word', count(DISTINCT (run_id, topic_id)) FROM topic_keywords)
"""
SQL = {
    "p4_counts": _TERMS + "SELECT field_name, term, n_occurrences, n_records FROM c",
    "p4_incremental": _TERMS + "SELECT field_name, term, n_occurrences, n_records FROM c",
    "p4_found": _TERMS
    + """SELECT field_name, term, 'rare' AS mark FROM c WHERE n_records < 3
UNION ALL SELECT field_name, term, 'common' FROM c JOIN s USING (field_name) WHERE n_records > 0.1 * n""",
}
