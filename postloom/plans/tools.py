"""Queries over single functions: texts for display, JSON redaction, times, buckets, leaks of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.functions import times as M
from postloom.functions.jsonx import ago, hash_fields, leak_count, redact_paths, strip_entry_prefix
from postloom.functions.numbers import delta_direction, ring_index, size_tier
from postloom.io import table
from postloom.plans import instants
from postloom.plans.posts import _TOKENS, WORDS

# Lines of a page that are no text of a post.
PAGE_LINES = [
    r"(?i)^(Like|Comment|Share|Send|React)$", r"(?i)^\d+\s*(likes?|comments?|shares?|reactions?)$", r"(?i)^(Write a comment|Press enter to post).*", r"(?i)^(See more|See less|See translation)$",
    r"(?i)^(Photo|Video|Live Video|Reel)$", r"(?i)^Log\s*In", r"(?i)^Sign\s*Up", r"(?i)^(Create new account|Forgotten password)", r"(?i)^All reactions:",
]
MESSENGER = ["Message sent", "end-to-end encryption", "Enter, Message sent", "You replied to", "Sent\nEnter"]
NOW = 1_780_000_000
ALLOWED, LEAKS = ["computer lab", "Science Hall"], [r"\bHall\b", r"\blab\b", r"(?i)\blibrary\b", r"#\w+FW\d+"]


def _posts(spark, d, *columns):
    return table(spark, d, "golden_input", "row_id", *columns)


def page_blocks(spark, d):
    """Posts as a page shows them (with its own lines around) and the block of text found again."""
    shown = F.concat(F.lit("Photo\n"), F.col("text"), F.lit("\n12 comments\nLike\nSee more\n\nWrite a comment here"))
    return _posts(spark, d, "text").where("text IS NOT NULL").select("row_id", T.longest_block(shown, PAGE_LINES).alias("block"))


def page_noise(spark, d):
    """Posts that are comments or messenger lines: a comment link, a messenger phrase, or a short text whose last line is a reply mark."""
    t = F.coalesce("text", F.lit(""))
    lines = F.split(F.trim(t), "\n")
    last = F.element_at(lines, -1)
    reply = (F.size(lines) >= 2) & F.lower(F.trim(last)).startswith("reply") & F.contains(last, F.lit("Reply")) & (F.length(t) < 200)
    said = reduce(lambda a, s: a | F.contains(t, F.lit(s)), MESSENGER, F.lit(False))
    link = F.contains(F.coalesce("post_url", F.lit("")), F.lit("comment_id="))
    return _posts(spark, d, "text", "post_url", "source").groupBy("source", F.when(link, "link").when(said, "messenger").when(reply, "reply").otherwise("post").alias("kind")).agg(F.count("*").alias("n"))


def card_texts(spark, d):
    """Texts as cards show them: without import prefix, cut to 240 characters, escaped, tags marked."""
    t = F.concat(F.lit("Entry 0012: "), F.col("text"), F.lit(" [REDACTED_NAME]"))
    return _posts(spark, d, "text").where("text IS NOT NULL").select("row_id", T.highlight_tags(T.escape_html(T.head(strip_entry_prefix(t), 240))).alias("card"))


def shown_times(spark, d):
    """Instants as day, month, time on the wall's clock and age."""
    e = instants.found(spark, d)
    s = F.col("epoch_s")
    return e.select("row_id", M.day_key(s).cast("string").alias("day"), M.month_key(s).alias("month"), M.wall_iso(s).alias("wall"), ago(s, F.lit(NOW)).alias("age"))


def relative_stamps(spark, d):
    """What relative stamps mean at a given instant, by stamp."""
    p = _posts(spark, d, "timestamp_raw").where("timestamp_raw IS NOT NULL")
    return p.select(F.lower(F.trim("timestamp_raw")).alias("stamp"), M.relative_epoch(F.col("timestamp_raw"), F.lit(NOW)).alias("epoch_s")).where("epoch_s IS NOT NULL").distinct()


def wall_buckets(spark, d):
    """Size tier of every wall, its place on a ring of fifteen colours, and how its share of posts compares with an even one."""
    n = _posts(spark, d, "_test_source_code").groupBy(F.col("_test_source_code").alias("source_code")).agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    j = n.join(F.broadcast(total))  # one row
    delta = F.col("n") / F.col("total") - 1 / F.col("k")
    return j.select("source_code", "n", size_tier(F.col("n"), (100, 250)).alias("tier"), ring_index(F.col("first") - 7, 15).alias("ring"), delta_direction(delta).alias("direction"), delta_direction(delta, invert=True).alias("inverted"))


def name_leaks(spark, d):
    """How many patterns of places still hit a text once the allowed phrases are masked."""
    return _posts(spark, d, "text").where("text IS NOT NULL").select("row_id", leak_count(F.col("text"), ALLOWED, LEAKS).alias("n_leaks"))


def redacted_payloads(spark, d):
    """The raw payloads with the labels and error codes hidden at any depth, how many tags that made, and the payloads with
    their labels replaced by the hash of their canonical form."""
    p = table(spark, d, "label_raw", "record_id", "payload")
    hidden = redact_paths("payload", ["labels.*.label", "*.label", "label"], "[HIDDEN]")
    hashed = hash_fields("payload", ["labels"])
    return p.select("record_id", T.count_matches(hidden, r"\[HIDDEN\]").alias("n_hidden"), F.length(hashed).alias("hashed_chars"), F.contains(hashed, F.lit("labels_sha256")).alias("is_hashed"))


def label_words(spark, d):
    """Labels without quotes around them, their first three words, and whether they hold letters beyond ASCII or words of both languages."""
    l = table(spark, d, "topic_labels", "record_id", "label").where("label IS NOT NULL")
    quoted = F.concat(F.lit("\"'"), F.col("label"), F.lit("'\""))
    ts = T.words(F.col("label"), "[a-z']+")
    mixed = F.arrays_overlap(ts, F.array(*map(F.lit, WORDS["tl"]))) & F.arrays_overlap(ts, F.array(*map(F.lit, WORDS["en"])))
    return l.select("record_id", T.unquote(quoted).alias("bare"), T.first_words(F.col("label"), 3).alias("short"), F.col("label").rlike(r"[^\x00-\x7F]").alias("beyond_ascii"), mixed.alias("is_mixed"))


QUERIES = {f.__name__: f for f in (page_blocks, page_noise, card_texts, shown_times, relative_stamps, wall_buckets, name_leaks, redacted_payloads, label_words)}


def _q(s: str) -> str:
    return s.replace("'", "''")


_LIST = {k: ", ".join("'" + _q(w) + "'" for w in v) for k, v in WORDS.items()}
_TERMS = "(SELECT '\\b(?:' || string_agg(regexp_escape(t), '|' ORDER BY length(t) DESC, t) || ')\\b' FROM (SELECT DISTINCT term AS t FROM flag_terms WHERE term IS NOT NULL))"
_MASKED = reduce(lambda x, a: f"replace({x}, '{a}', ' ')", sorted(ALLOWED, key=lambda x: (-len(x), x)), "text")
_STRIP = "regexp_replace({t}, '^[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+$', '', 'g')"
_ANY = " OR ".join(f"regexp_matches(trim(x, ' '), '{_q(p.removeprefix('(?i)'))}', 'i')" for p in PAGE_LINES)
SQL = {
    "page_blocks": f"""WITH l AS (SELECT row_id, array_to_string(list_transform(list_filter(string_split('Photo' || chr(10) || text || chr(10) || '12 comments' || chr(10) || 'Like' || chr(10) || 'See more' || chr(10) || chr(10) || 'Write a comment here', chr(10)),
        lambda x: NOT ({_STRIP.format(t="x")} = '' OR {_ANY})), lambda x: {_STRIP.format(t="x")}), chr(10)) AS b FROM golden_input WHERE text IS NOT NULL) SELECT row_id, CASE WHEN length(b) >= 6 THEN b END AS block FROM l""",
    "page_noise": f"""WITH p AS (SELECT source, coalesce(post_url, '') AS u, coalesce(text, '') AS t, string_split(trim(coalesce(text, ''), ' '), chr(10)) AS l FROM golden_input)
        SELECT source, CASE WHEN contains(u, 'comment_id=') THEN 'link' WHEN {" OR ".join(f"contains(t, '{_q(m)}')" for m in MESSENGER)} THEN 'messenger'
        WHEN len(l) >= 2 AND starts_with(lower(trim(l[-1], ' ')), 'reply') AND contains(l[-1], 'Reply') AND length(t) < 200 THEN 'reply' ELSE 'post' END AS kind, count(*) AS n FROM p GROUP BY 1, 2""",
    "card_texts": """WITH c AS (SELECT row_id, regexp_replace(text || ' [REDACTED_NAME]', '^\\s+', '') AS t FROM golden_input WHERE text IS NOT NULL),
        h AS (SELECT row_id, CASE WHEN length(t) > 240 THEN left(t, 240) || '…' ELSE t END AS t FROM c)
        SELECT row_id, regexp_replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '(\\[REDACTED_[A-Z_]+\\])', '<mark>\\1</mark>', 'g') AS card FROM h""",
    "shown_times": f"""WITH e AS (SELECT row_id, epoch_s, make_timestamp(epoch_s * 1000000) AS t FROM ({instants.SQL["p6_found"]}))
        SELECT row_id, strftime(t, '%Y-%m-%d') AS day, strftime(t, '%Y-%m') AS month, strftime(t + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS wall,
        CASE WHEN {NOW} - epoch_s < 60 THEN 'just now' WHEN {NOW} - epoch_s < 3600 THEN (({NOW} - epoch_s) // 60) || 'm' WHEN {NOW} - epoch_s < 86400 THEN (({NOW} - epoch_s) // 3600) || 'h'
        WHEN {NOW} - epoch_s < 604800 THEN (({NOW} - epoch_s) // 86400) || 'd' ELSE (({NOW} - epoch_s) // 604800) || 'w' END AS age FROM e""",
    "relative_stamps": f"""WITH s AS (SELECT DISTINCT lower(trim(timestamp_raw, ' ')) AS s FROM golden_input WHERE timestamp_raw IS NOT NULL),
        r AS (SELECT s, regexp_extract(s, '^(\\d{{1,4}})\\s*(s|secs?|m|mins?|h|hrs?|d|days?|w|weeks?|mo|months?|y|yrs?|years?)(?:\\s+ago)?$', ['n', 'u']) AS m FROM s)
        SELECT s AS stamp, (CASE WHEN s = 'just now' THEN {NOW} WHEN s = 'yesterday' THEN {NOW} - 86400 ELSE {NOW} - try_cast(m.n AS BIGINT) * CASE WHEN m.u LIKE 's%' THEN 1 WHEN m.u LIKE 'mo%' THEN 2592000 WHEN m.u LIKE 'm%' THEN 60
        WHEN m.u LIKE 'h%' THEN 3600 WHEN m.u LIKE 'd%' THEN 86400 WHEN m.u LIKE 'w%' THEN 604800 ELSE 31536000 END END)::BIGINT AS epoch_s FROM r WHERE s IN ('just now', 'yesterday') OR m.n <> ''""",
    "wall_buckets": """WITH n AS (SELECT _test_source_code AS source_code, count(*) AS n, min(row_id) AS f FROM golden_input GROUP BY 1), x AS (SELECT *, n / sum(n) OVER () - 1 / count(*) OVER () AS d FROM n)
        SELECT source_code, n, CASE WHEN n < 100 THEN 'small' WHEN n < 250 THEN 'medium' ELSE 'large' END AS tier, (((f - 7) % 15) + 15) % 15 AS ring,
        CASE WHEN abs(d) < 0.005 THEN 'flat' WHEN d > 0 THEN 'better' ELSE 'worse' END AS direction, CASE WHEN abs(d) < 0.005 THEN 'flat' WHEN d > 0 THEN 'worse' ELSE 'better' END AS inverted FROM x""",
    "name_leaks": "SELECT row_id, " + " + ".join(f"regexp_matches({_MASKED}, '{p.removeprefix('(?i)')}'{', ' + chr(39) + 'i' + chr(39) if p.startswith('(?i)') else ''})::INT" for p in LEAKS) + " AS n_leaks FROM golden_input WHERE text IS NOT NULL",
    "label_words": f"""SELECT record_id, label AS bare, array_to_string(string_split_regex(trim(label, ' '), '\\s+')[1:3], ' ') AS short, regexp_matches(label, '[^\\x00-\\x7F]') AS beyond_ascii,
        list_has_any(ts, [{_LIST["tl"]}]) AND list_has_any(ts, [{_LIST["en"]}]) AS is_mixed FROM (SELECT record_id, label, regexp_extract_all(lower(label), '[a-z'']+') AS ts FROM topic_labels WHERE label IS NOT NULL)""",
    "redacted_words": f"""WITH x AS (SELECT row_id, text, regexp_replace(text, {_TERMS}, '[TERM]', 'gi') AS r FROM golden_input WHERE text IS NOT NULL)
        SELECT row_id, regexp_replace(r, '\\[TERM\\](?:\\s+\\[TERM\\])+', '[TERM]', 'g') AS redacted_text, len(regexp_extract_all(text, '(?i)' || {_TERMS})) AS n_terms FROM x""",
}
