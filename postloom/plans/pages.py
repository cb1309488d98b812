"""What the pages and reports ask of the tables: filters, rankings, assessments."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions import text as T
from postloom.functions.jsonx import nfkc, numbered, render
from postloom.io import table
from postloom.operators.dedup import keep_first
from postloom.plans.posts import STOP
from postloom.plans.scores import _latest
from postloom.plans.topics import _labels


def valence_terms(spark: SparkSession, d: str):
    """Terms by the number of scored posts that hold them, with the mean valence of those posts: the 40 most frequent."""
    posts = keep_first(table(spark, d, "golden_input", "post_id", "row_id", "text"), ["post_id"], [F.desc("row_id")])
    j = posts.join(_latest(spark, d).select("post_id", "v"), "post_id").select("v", F.explode(F.array_distinct(T.chart_terms(F.col("text"), STOP))).alias("term"))
    return j.groupBy("term").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("mean_v")).orderBy(F.desc("n"), "term").limit(40)


def top_labels(spark, d):
    """The three most frequent language labels of every source with their share in whole per cent."""
    p = table(spark, d, "golden_input", "_test_source_code", "lang_label").select(F.col("_test_source_code").alias("source_code"), F.coalesce(F.lower(F.trim("lang_label")), F.lit("")).alias("label"))
    n = p.groupBy("source_code", "label").agg(F.count("*").alias("n")).withColumn("pct", F.floor(100 * F.col("n") / F.sum("n").over(W.partitionBy("source_code"))).cast("int"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("source_code").orderBy(F.desc("n"), "label"))).where("k <= 3")


def month_counts(spark, d):
    """Scores per month (UTC) of every university, its months and the greatest month."""
    m = _latest(spark, d).where("scored_at IS NOT NULL").groupBy("univ_code", F.date_format("scored_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    e = F.array_sort(F.collect_list(F.struct("month", "n")))
    joined = F.array_join(F.transform(e, lambda x: F.concat(x["month"], F.lit("="), x["n"].cast("string"))), ",")
    return m.groupBy("univ_code").agg(F.count("*").alias("n_months"), F.max("n").alias("most"), joined.alias("months"))


def assessment(spark, d):
    """Per university: topics of ten posts or more, lazy share, label runs, and whether a look is needed (any check fails)."""
    a = table(spark, d, "topic_assignments").where("topic_id >= 0").groupBy("univ_code", "run_id", "topic_id").agg(F.count("*").alias("n"))
    big = a.groupBy("univ_code").agg(F.count_if(F.col("n") >= 10).alias("n_big"), F.count("*").alias("n_topics"))
    l = _labels(spark, d).groupBy("univ_code").agg(F.round(F.avg(F.coalesce(F.array_contains("flags", "lazy"), F.lit(False)).cast("int")), 4).alias("lazy"), F.count_distinct("run_id").alias("n_runs"))  # noqa: E741
    j = big.join(l, "univ_code", "left")
    good = (F.col("n_big") >= 3) & (F.coalesce("lazy", F.lit(1.0)) <= 0.2) & (F.coalesce("n_runs", F.lit(0)) == 1)
    return j.withColumn("needs_review", ~good)


def insight(spark, d):
    """Of every university the largest topic with its share, and the most negative one of ten posts or more."""
    s = _latest(spark, d).where("topic_id >= 0").groupBy("univ_code", "topic_id").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    s = s.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("univ_code")), 4))
    big = keep_first(s, ["univ_code"], [F.desc("n"), F.asc("topic_id")]).select("univ_code", F.col("topic_id").alias("largest"), "share")
    low = keep_first(s.where("n >= 10 AND m IS NOT NULL"), ["univ_code"], [F.asc("m"), F.asc("topic_id")]).select("univ_code", F.col("topic_id").alias("most_negative"))
    return big.join(low, "univ_code", "left")


def lowest_topics(spark, d):
    """The six topics of five scores or more with the lowest mean valence."""
    s = _latest(spark, d).where("topic_id <> -1 AND v IS NOT NULL").groupBy("univ_code", "topic_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean_v")).where("n >= 5")
    return s.orderBy("mean_v", "univ_code", "topic_id").limit(6)


def best_setting(spark, d):
    """Of every university's runs the one with most topics among those of two or more, else the one with most posts."""
    r = table(spark, d, "topic_assignments").groupBy("univ_code", "run_id").agg(F.count_distinct(F.when(F.col("topic_id") >= 0, F.col("topic_id"))).alias("n_topics"), F.count("*").alias("n"))
    return keep_first(r, ["univ_code"], [F.desc(F.col("n_topics") >= 2), F.desc("n"), F.asc("run_id")])


def mention_classes(spark, d):
    """Posts by whether their text names no wall's tag, only their own source's, or another's."""
    p = table(spark, d, "golden_input", "row_id", "text", "_test_source_code")
    tags = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("#([A-Z][a-z]+)(?:FW|FreedomWall|CampusWall)"), F.lit(1)))
    own = p.select("_test_source_code", F.explode(tags).alias("tag")).groupBy("_test_source_code", "tag").agg(F.count("*").alias("n"))
    own = keep_first(own, ["_test_source_code"], [F.desc("n"), F.asc("tag")]).select("_test_source_code", F.col("tag").alias("own"))
    j = p.select("_test_source_code", tags.alias("tags")).join(own, "_test_source_code", "left")
    kind = F.when(F.size("tags") == 0, "none").when(F.size(F.array_except("tags", F.array("own"))) == 0, "own").otherwise("other")
    return j.groupBy(kind.alias("mentions")).agg(F.count("*").alias("n"))


def first_by_text(spark, d):
    """The first post of every text: the reverse look-up of representative posts."""
    p = table(spark, d, "golden_input", "row_id", "post_id", "text").where("text IS NOT NULL")
    return keep_first(p, ["text"], [F.asc("row_id")]).select("row_id", "post_id")


def browser_page(spark, d):
    """Sarcastic posts of a topic other than noise, the longest text first: one page of the browser."""
    s = _latest(spark, d).where("sarcasm AND topic_id >= 0").select("post_id", "topic_id", "v")
    p = keep_first(table(spark, d, "golden_input", "row_id", "post_id", "text"), ["post_id"], [F.desc("row_id")])
    j = p.join(s, "post_id").select("post_id", "topic_id", F.coalesce(F.length("text"), F.lit(-99)).alias("len"), F.coalesce("v", F.lit(-99)).alias("v"))
    return j.orderBy(F.desc("len"), "post_id").limit(400)


def signal_posts(spark, d):
    """Posts that one of three signals points at, without those a reader has dismissed (topic 0)."""
    s = _latest(spark, d).select("post_id", "topic_id", "v", "a", "d", F.coalesce("sarcasm", F.lit(False)).alias("sarcasm"))
    kinds = F.array_compact(F.array(F.when((F.col("v") <= 3) & (F.col("a") >= 7), "crisis"), F.when((F.col("a") >= 5) & (F.col("d") < 5), "danger"), F.when(F.col("sarcasm"), "sarcasm")))
    e = s.select("post_id", "topic_id", F.explode(kinds).alias("signal"))
    gone = s.where("topic_id = 0").select("post_id")
    return e.join(gone, "post_id", "left_anti").groupBy("signal").agg(F.count("*").alias("n"))


def busy_sources(spark, d):
    """Posts of the sources that have at least three per cent of all: the volume guard, as a window."""
    n = table(spark, d, "golden_input", "_test_source_code").groupBy(F.col("_test_source_code").alias("source_code")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(W.partitionBy())).where("n >= 0.03 * total").select("source_code", "n")


def noise_posts(spark, d):
    """Posts that look like comments: a comment link, or a short text that ends in a reply mark or is one word."""
    t, u = F.coalesce("text", F.lit("")), F.coalesce("post_url", F.lit(""))
    comment = F.contains(u, F.lit("comment_id=")) | ((F.length(t) < 200) & F.element_at(F.split(t, "\n"), -1).rlike("(?i)^reply$")) | ~F.trim(t).rlike(r"\s")
    return table(spark, d, "golden_input", "text", "post_url").groupBy(comment.alias("is_noise")).agg(F.count("*").alias("n"))


def versions(spark, d):
    """Researchers and model versions of every university's scores."""
    one = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return table(spark, d, "vad_score").groupBy("univ_code").agg(one("researcher_id").alias("researchers"), one("model_version").alias("versions"), F.count_distinct("model_version").alias("n_versions"))


def prompts(spark, d):
    """The labelling prompt of every topic: its keywords as a numbered list in a template."""
    k = table(spark, d, "topic_keywords").where("word IS NOT NULL").groupBy("run_id", "topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kw_rank", F.lower(F.trim("word")).alias("w")))), lambda x: x["w"]).alias("ws"))
    return k.select("run_id", "topic_id", F.sha2(render("Name the topic.\n[KEYWORDS]\nTwo words.", keywords=numbered(F.col("ws"))), 256).alias("prompt_sha256"))


def normalised_words(spark, d):
    """Keywords in compatibility form and lower case, counted."""
    w = F.lower(T.strip(nfkc(F.col("word"))))
    return table(spark, d, "topic_keywords", "word").where("word IS NOT NULL").groupBy(w.alias("word")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        valence_terms, top_labels, month_counts, assessment, insight, lowest_topics, best_setting, mention_classes, first_by_text, browser_page, signal_posts, busy_sources, noise_posts,
        versions, prompts, normalised_words,
    )
}

_LATEST = "s AS (SELECT * FROM vad_score QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY scored_at DESC NULLS LAST, researcher_id NULLS FIRST, model_version NULLS FIRST, v NULLS FIRST, a NULLS FIRST, d NULLS FIRST, topic_id NULLS FIRST, univ_code NULLS FIRST) = 1)"
_POST = "post AS (SELECT * FROM golden_input QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY row_id DESC) = 1)"
_STOP_IN = ", ".join(f"'{w}'" for w in STOP)
SQL = {
    "valence_terms": f"""WITH {_LATEST}, {_POST},
        a AS (SELECT post.row_id, s.v, unnest(string_split_regex(trim(replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '\\[[A-Z_]+\\]', ' ', 'gi'), 'https?://\\S+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\s'']', ' ', 'g'), '''', ''), ' '), '\\s+')) AS w FROM post JOIN s USING (post_id)),
        b AS (SELECT * FROM a WHERE length(w) >= 3 AND w NOT IN ({_STOP_IN}) AND NOT regexp_full_match(w, '[0-9]+')),
        c AS (SELECT DISTINCT row_id, v, CASE WHEN length(w) < 4 THEN w WHEN w = 'children' THEN 'child' WHEN w = 'men' THEN 'man' WHEN w = 'women' THEN 'woman' WHEN w = 'people' THEN 'person' WHEN w = 'feet' THEN 'foot'
          WHEN w = 'teeth' THEN 'tooth' WHEN w = 'mice' THEN 'mouse' WHEN w = 'geese' THEN 'goose' WHEN w LIKE '%ies' AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y')
          WHEN regexp_matches(w, '(sses|ches|shes|xes)$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^sui]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS term FROM b)
        SELECT term, count(*) AS n, round(avg(v), 3) AS mean_v FROM c WHERE length(term) >= 3 AND term NOT IN ({_STOP_IN}) GROUP BY 1 ORDER BY n DESC, term LIMIT 40""",
    "top_labels": """WITH n AS (SELECT _test_source_code AS source_code, coalesce(lower(trim(lang_label, ' ')), '') AS label, count(*) AS n FROM golden_input GROUP BY ALL)
        SELECT source_code, label, n, floor(100 * n / sum(n) OVER (PARTITION BY source_code))::INT AS pct, row_number() OVER (PARTITION BY source_code ORDER BY n DESC, label) AS k FROM n QUALIFY k <= 3""",
    "month_counts": f"WITH {_LATEST}, m AS (SELECT univ_code, strftime(scored_at, '%Y-%m') AS month, count(*) AS n FROM s WHERE scored_at IS NOT NULL GROUP BY ALL) SELECT univ_code, count(*) AS n_months, max(n) AS most, string_agg(month || '=' || n, ',' ORDER BY month) AS months FROM m GROUP BY 1",
    "assessment": """WITH lab AS (SELECT * FROM topic_labels QUALIFY row_number() OVER (PARTITION BY run_id, univ_code, topic_id ORDER BY record_id DESC) = 1), a AS (SELECT univ_code, run_id, topic_id, count(*) AS n FROM topic_assignments WHERE topic_id >= 0 GROUP BY ALL),
        b AS (SELECT univ_code, count(*) FILTER (n >= 10) AS n_big, count(*) AS n_topics FROM a GROUP BY 1), l AS (SELECT univ_code, round(avg(coalesce(list_contains(flags, 'lazy'), false)::INT), 4) AS lazy, count(DISTINCT run_id) AS n_runs FROM lab GROUP BY 1)
        SELECT b.univ_code, n_big, n_topics, lazy, n_runs, NOT (n_big >= 3 AND coalesce(lazy, 1) <= 0.2 AND coalesce(n_runs, 0) = 1) AS needs_review FROM b LEFT JOIN l USING (univ_code)""",
    "insight": f"""WITH {_LATEST}, g AS (SELECT univ_code, topic_id, count(*) AS n, avg(v) AS m FROM s WHERE topic_id >= 0 GROUP BY ALL), h AS (SELECT *, round(n / sum(n) OVER (PARTITION BY univ_code), 4) AS share FROM g),
        big AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY univ_code ORDER BY n DESC, topic_id) = 1), low AS (SELECT * FROM h WHERE n >= 10 AND m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY univ_code ORDER BY m, topic_id) = 1)
        SELECT big.univ_code, big.topic_id AS largest, big.share, low.topic_id AS most_negative FROM big LEFT JOIN low USING (univ_code)""",
    "lowest_topics": f"WITH {_LATEST}, g AS (SELECT univ_code, topic_id, count(*) AS n, round(avg(v), 4) AS mean_v FROM s WHERE topic_id <> -1 AND v IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) SELECT * FROM g ORDER BY mean_v, univ_code, topic_id LIMIT 6",
    "best_setting": """WITH r AS (SELECT univ_code, run_id, count(DISTINCT topic_id) FILTER (topic_id >= 0) AS n_topics, count(*) AS n FROM topic_assignments GROUP BY ALL)
        SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY univ_code ORDER BY n_topics >= 2 DESC, n DESC, run_id) = 1""",
    "mention_classes": """WITH t AS (SELECT row_id, _test_source_code AS c, list_distinct(regexp_extract_all(coalesce(text, ''), '#([A-Z][a-z]+)(?:FW|FreedomWall|CampusWall)', 1)) AS tags FROM golden_input),
        n AS (SELECT c, tag, count(*) AS n FROM (SELECT c, unnest(tags) AS tag FROM t) GROUP BY ALL), o AS (SELECT c, tag AS own FROM n QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, tag) = 1)
        SELECT CASE WHEN len(tags) = 0 THEN 'none' WHEN len(list_filter(tags, lambda x: x <> own)) = 0 THEN 'own' ELSE 'other' END AS mentions, count(*) AS n FROM t LEFT JOIN o USING (c) GROUP BY 1""",
    "first_by_text": "SELECT row_id, post_id FROM golden_input WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1",
    "browser_page": f"WITH {_LATEST}, {_POST} SELECT post_id, s.topic_id, coalesce(length(text), -99) AS len, coalesce(v, -99) AS v FROM post JOIN s USING (post_id) WHERE sarcasm AND s.topic_id >= 0 ORDER BY len DESC, post_id LIMIT 400",
    "signal_posts": f"""WITH {_LATEST}, e AS (SELECT post_id, 'crisis' AS signal FROM s WHERE v <= 3 AND a >= 7 UNION ALL SELECT post_id, 'danger' FROM s WHERE a >= 5 AND d < 5 UNION ALL SELECT post_id, 'sarcasm' FROM s WHERE sarcasm)
        SELECT signal, count(*) AS n FROM e WHERE post_id NOT IN (SELECT post_id FROM s WHERE topic_id = 0) GROUP BY 1""",
    "busy_sources": "WITH n AS (SELECT _test_source_code AS source_code, count(*) AS n FROM golden_input GROUP BY 1) SELECT * FROM n WHERE n >= 0.03 * (SELECT sum(n) FROM n)",
    "noise_posts": "SELECT contains(coalesce(post_url, ''), 'comment_id=') OR (length(coalesce(text, '')) < 200 AND regexp_matches(string_split(coalesce(text, ''), chr(10))[-1], '^reply$', 'i')) OR NOT regexp_matches(trim(coalesce(text, ''), ' '), '\\s') AS is_noise, count(*) AS n FROM golden_input GROUP BY 1",
    "versions": "SELECT univ_code, coalesce(string_agg(DISTINCT researcher_id, ',' ORDER BY researcher_id), '') AS researchers, coalesce(string_agg(DISTINCT model_version, ',' ORDER BY model_version), '') AS versions, count(DISTINCT model_version) AS n_versions FROM vad_score GROUP BY 1",
    "prompts": """WITH k AS (SELECT run_id, topic_id, row_number() OVER (PARTITION BY run_id, topic_id ORDER BY kw_rank, lower(trim(word, ' '))) AS i, lower(trim(word, ' ')) AS w FROM topic_keywords WHERE word IS NOT NULL)
        SELECT run_id, topic_id, sha256('Name the topic.' || chr(10) || string_agg(i || '. ' || w, chr(10) ORDER BY i) || chr(10) || 'Two words.') AS prompt_sha256 FROM k GROUP BY ALL""",
    "normalised_words": "SELECT regexp_replace(lower(nfc_normalize(word)), '^\\s+|\\s+$', '', 'g') AS word, count(*) AS n FROM topic_keywords WHERE word IS NOT NULL GROUP BY 1",
}
