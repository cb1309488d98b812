"""Sources, sinks and streams, run over the tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postloom.io import table
from postloom.session import scratch_path
from postloom.sources.html_pages import parse_pages
from postloom.sources.json_files import POST, find_objects, key_paths, read_jsonl
from postloom.sources.sinks import append_new, write_partitioned
from postloom.streaming.incremental import first_seen, read_new, run_now, session_counts, upsert_once, window_counts


def jsonl_round_trip(spark: SparkSession, d: str):
    """Posts written as JSON lines and read with the fixed schema, counted by how they were collected."""
    path = scratch_path(spark, "jsonl")
    table(spark, d, "golden_input", "post_id", "text", "timestamp_iso", "timestamp_raw", "post_url", "source", "engagement").write.json(path)
    r = read_jsonl(spark, path, POST)
    return r.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_distinct("post_id").alias("n_posts"), F.count("engagement.reactions").alias("n_reactions"))


def per_source_files(spark, d):
    """Documents written as one folder of JSON lines per source, read back with the source from the path."""
    path = scratch_path(spark, "per-source")
    write_partitioned(table(spark, d, "documents", "doc_id", "source", "lang").where("source IS NOT NULL"), path, "source")
    back = spark.read.schema("doc_id long, lang string, source string").json(path)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"))


def payload_paths(spark, d):
    return key_paths(table(spark, d, "label_raw", "payload"), "payload")


def payload_objects(spark, d):
    """All objects with token counts at any depth of the raw payloads."""
    o = find_objects(table(spark, d, "label_raw", "record_id", "payload"), "record_id", "payload", ["prompt_tokens", "total_tokens"])
    return o.groupBy("record_id").agg(F.count("*").alias("n"))


def page_posts(spark, d):
    """Posts laid out as HTML pages of one wall's day and parsed again: text, reactions and next page of each."""
    p = table(spark, d, "golden_input", "row_id", "text", "engagement", "post_url").where("text IS NOT NULL")
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), "\n", "<br>")
    html = F.concat(
        F.lit("<html><body><article><div class='post-text'>"), esc, F.lit("</div><span class='reactions'>"), F.coalesce(F.col("engagement.reactions").cast("string"), F.lit("")),
        F.lit("</span><a class='permalink' href='"), F.coalesce("post_url", F.lit("")), F.lit("'>link</a></article><a rel='next' href='/p2'>more</a></body></html>"),
    )
    got = parse_pages(p.select("row_id", html.alias("html")), "row_id", "html")
    return got.select("row_id", "post_no", "text", "reactions", "next_page")


def appended_once(spark, d):
    """Posts appended in three overlapping deliveries; every post lands once."""
    path = scratch_path(spark, "appended")
    p = table(spark, d, "golden_input", "post_id", "source").where("post_id IS NOT NULL")
    for part in ("graphql", "desktop", None):
        append_new(p if part is None else p.where(F.col("source") == part), path, "post_id")
    return spark.read.schema(p.schema).parquet(path).agg(F.count("*").alias("n"), F.count_distinct("post_id").alias("n_posts"))


def _event_stream(spark, d):
    path = scratch_path(spark, "events")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # Arrival in order of time, one file per range, as a feed delivers it.
    e.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(path)
    return read_new(spark, path, e.schema, files_per_batch=2)


def stream_days(spark, d):
    """Events per day and type, counted by a stream in complete mode."""
    out = scratch_path(spark, "days")
    days = window_counts(_event_stream(spark, d), "ts", "1 day", ["event_type"], late="400 days")
    run_now(days, scratch_path(spark, "ck"), each=lambda b, _: b.write.mode("overwrite").parquet(out), mode="complete")
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sessions(spark, d):
    """Sessions of users with a gap of 30 minutes, from a stream; the last ones close with its end."""
    out = scratch_path(spark, "sessions")
    s = session_counts(_event_stream(spark, d), "ts", "30 minutes", "user_id", late="400 days")
    run_now(s, scratch_path(spark, "ck"), each=lambda b, _: b.write.mode("overwrite").parquet(out), mode="complete")
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("most_events"))


def stream_first_posts(spark, d):
    """The posts of an append-only log, each id once, taken in batch by batch into a table that a repeated batch leaves as it is."""
    log, out = scratch_path(spark, "log"), scratch_path(spark, "first")
    p = table(spark, d, "golden_input", "post_id", "source").where("post_id IS NOT NULL")
    p.repartition(6, "post_id").write.parquet(log)
    run_now(first_seen(read_new(spark, log, p.schema, files_per_batch=2), "post_id"), scratch_path(spark, "ck"), each=upsert_once(out, "post_id"))
    return spark.read.schema("post_id string, source string, batch_no int").parquet(out).agg(F.count("*").alias("n"), F.count_distinct("post_id").alias("n_posts"))


QUERIES = {
    f.__name__: f
    for f in (jsonl_round_trip, per_source_files, payload_paths, payload_objects, page_posts, appended_once, stream_days, stream_sessions, stream_first_posts)
}
QUERIES["html_posts"] = QUERIES.pop("page_posts")

SQL = {
    "jsonl_round_trip": "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT post_id) AS n_posts, count(engagement.reactions) AS n_reactions FROM golden_input GROUP BY 1",
    "per_source_files": "SELECT source, count(*) AS n, count(lang) AS n_lang FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "html_posts": "SELECT row_id, 1 AS post_no, text, greatest(coalesce(engagement.reactions, 0), 0) AS reactions, '/p2' AS next_page FROM golden_input WHERE text IS NOT NULL",
    "appended_once": "SELECT count(DISTINCT post_id) AS n, count(DISTINCT post_id) AS n_posts FROM golden_input",
    "stream_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x),
        g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS most_events FROM g GROUP BY 1""",
    "stream_first_posts": "SELECT count(DISTINCT post_id) AS n, count(DISTINCT post_id) AS n_posts FROM golden_input",
}
