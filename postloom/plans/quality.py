"""Checks of runs, labels and scores: assessments, choices between settings, agreement, retries, terms and texts of topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions import text as T
from postloom.functions.numbers import clamp, valence_band
from postloom.io import table
from postloom.operators.clusters import class_terms
from postloom.operators.dedup import keep_first
from postloom.operators.scores import agreement, largest_first, parse_answer
from postloom.plans import topics
from postloom.plans.posts import STOP
from postloom.plans.scores import ORDER, _latest, _scores
from postloom.plans.topics import TOPIC, _assigned, _classed, _labels, class_npmi

HIGH_OUTLIERS, LEAST_TOPICS, MOST_LAZY, LEAST_NPMI = 0.6, 3, 0.2, -0.2
WEIGHTS = {"npmi": 0.5, "silhouette": 0.3, "low_outliers": 0.2}


def composite(npmi: Column, silhouette: Column, outlier_rate: Column) -> Column:
    """One score of a setting: coherence, separation and few outliers, weighted."""
    return WEIGHTS["npmi"] * npmi + WEIGHTS["silhouette"] * silhouette + WEIGHTS["low_outliers"] * (1 - outlier_rate)


def _outliers(spark, d):
    a = _assigned(spark, d)
    return a.groupBy("univ_code").agg(F.count("*").alias("n_posts"), F.round(F.avg((F.col("topic_id") == -1).cast("int")), 4).alias("outlier_rate"))


def assessment_checks(spark, d):
    """Per university every check of the assessment: outlier rate, topics of ten posts or more, lazy labels, coherence, one
    cached prompt per label, drift of the model; a look is needed unless all but the last hold."""
    big = _assigned(spark, d).where("topic_id <> -1").groupBy(*TOPIC).agg(F.count("*").alias("n")).groupBy("univ_code").agg(F.count_if(F.col("n") >= 10).alias("n_big"))
    raw = table(spark, d, "topic_labels", *TOPIC, "record_id", "flags", "prompt_sha256", F.col("response_meta.model").alias("model"))
    lab = keep_first(raw, TOPIC, [F.desc("record_id")])
    lab = lab.groupBy("univ_code").agg(
        F.round(F.avg(F.coalesce(F.array_contains("flags", "lazy"), F.lit(False)).cast("int")), 4).alias("lazy"), F.count("*").alias("n_labels"),
        F.count_distinct("prompt_sha256").alias("n_cached"), F.count_distinct("model").alias("n_models"),
    )
    npmi = class_npmi(spark, d).groupBy(F.split_part("class", F.lit("/"), F.lit(1)).alias("univ_code")).agg(F.round(F.avg("npmi"), 3).alias("npmi"))
    j = _outliers(spark, d).join(big, "univ_code", "left").join(lab, "univ_code", "left").join(npmi, "univ_code", "left")
    checks = {
        "outlier_rate_ok": F.col("outlier_rate") <= HIGH_OUTLIERS, "min_topics_ok": F.coalesce("n_big", F.lit(0)) >= LEAST_TOPICS, "lazy_label_ok": F.coalesce("lazy", F.lit(0.0)) <= MOST_LAZY,
        "npmi_ok": F.coalesce("npmi", F.lit(0.0)) >= LEAST_NPMI, "cache_count_matches": F.coalesce("n_cached", F.lit(0)) == F.coalesce("n_labels", F.lit(0)),
    }
    j = j.withColumns(checks).withColumn("model_version_drift", F.coalesce("n_models", F.lit(0)) > 1)
    every = F.forall(F.array(*checks), lambda c: c)
    return j.select("univ_code", "n_posts", "outlier_rate", *checks, "model_version_drift", (~every).alias("needs_review"))


def label_flags(spark, d):
    """Universities of many outliers, lazy labels, and labels that stand in several universities, as one list."""
    high = _outliers(spark, d).where(F.col("outlier_rate") > 0.1).select(F.lit("outliers").alias("flag"), "univ_code", F.lit(None).cast("int").alias("topic_id"), F.col("outlier_rate").cast("string").alias("what"))
    l = _labels(spark, d).where("label IS NOT NULL")
    lazy = l.where(F.array_contains("flags", "lazy")).select(F.lit("lazy").alias("flag"), "univ_code", "topic_id", F.col("label").alias("what"))
    shared = l.where("label <> 'Unlabeled'").withColumn("k", F.size(F.collect_set("univ_code").over(W.partitionBy("label")))).where("k > 1")
    return high.unionByName(lazy).unionByName(shared.select(F.lit("shared").alias("flag"), "univ_code", "topic_id", F.col("label").alias("what")))


def grid_choice(spark, d):
    """The best run of every university by its composite score among those with four topics or more, else among all. Runs
    bring no vectors here, so their silhouette is 0, as for runs of fewer than two clusters."""
    npmi = class_npmi(spark, d).withColumn("univ_code", F.split_part("class", F.lit("/"), F.lit(1))).withColumn("topic_id", F.split_part("class", F.lit("/"), F.lit(2)).cast("int"))
    a = _assigned(spark, d)
    runs = a.groupBy("univ_code", "run_id").agg(F.avg((F.col("topic_id") == -1).cast("int")).alias("outlier_rate"), F.count_distinct(F.when(F.col("topic_id") >= 0, F.col("topic_id"))).alias("n_clusters"))
    mean = a.select("univ_code", "run_id", "topic_id").distinct().join(npmi, ["univ_code", "topic_id"]).groupBy("univ_code", "run_id").agg(F.avg("npmi").alias("npmi"))
    s = runs.join(mean, ["univ_code", "run_id"], "left").withColumn("score", F.round(composite(F.coalesce("npmi", F.lit(0.0)), F.lit(0.0), F.col("outlier_rate")), 4))
    best = keep_first(s, ["univ_code"], [F.desc(F.col("n_clusters") >= 4), F.desc("score"), F.asc("run_id")])
    return best.select("univ_code", "run_id", "n_clusters", "score", (F.col("n_clusters") < 4).alias("below_floor"))


def gold_agreement(spark, d):
    """Scores of two model versions of the same posts against each other, the first as gold: within one step, correlation,
    kappa of sarcasm, agreement of labels, and the size of the five per cent sample drawn by hash."""
    s = _scores(spark, d).where("v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL AND sarcasm IS NOT NULL")
    of = lambda version, tag: keep_first(s.where(F.col("model_version") == version), ["post_id"], [F.desc("scored_at"), *[F.asc(c) for c in ORDER]]).select("post_id", *[F.col(c).alias(f"{c}{tag}") for c in ("v", "a", "d", "sarcasm", "topic_label")])
    j = of("mock-70b-v1", 1).join(of("mock-70b-v2", 2), "post_id")
    out = agreement(j, {c: (f"{c}1", f"{c}2") for c in "vad"}, ("sarcasm1", "sarcasm2"))
    more = j.agg(F.avg(F.col("topic_label1").eqNullSafe(F.col("topic_label2")).cast("int")).alias("label_agreement"), F.count_if(F.substring(F.md5("post_id"), 1, 2) < "0d").alias("n_sample"))
    out = out.join(F.broadcast(more))  # one row each
    return out.select(*[F.round(c, 4).alias(c) if c not in ("n", "n_sample") else c for c in out.columns])


def _grams(ts: Column) -> Column:
    kept = F.filter(ts, lambda t: (F.length(t) >= 2) & ~t.isin(STOP))
    pairs = F.transform(F.sequence(F.lit(1), F.size(kept) - 1), lambda i: F.array_join(F.slice(kept, i, F.lit(2)), " "))
    return F.when(F.size(kept) > 1, F.concat(kept, pairs)).otherwise(kept)


def class_ngrams(spark, d):
    """The ten words or pairs of words of greatest class TF-IDF of every topic, stop words left out first."""
    return class_terms(_classed(spark, d).select("class", _grams(F.col("ts")).alias("gs")), "class", "gs", 10).withColumn("score", F.round("score", 6))


def representative_posts(spark, d):
    """The five posts of every topic that are nearest to it: cosine of their weighted terms with the topic's."""
    c = _classed(spark, d).select("class", "row_id", F.filter("ts", lambda t: (F.length(t) >= 2) & ~t.isin(STOP)).alias("ts"))
    tf = c.select("class", "row_id", F.explode("ts").alias("term")).groupBy("class", "row_id", "term").agg(F.count("*").alias("f"))
    of_class = tf.groupBy("class", "term").agg(F.sum("f").alias("cf"))
    size = of_class.groupBy("class").agg(F.sum("cf").alias("n"))
    mean, total = size.agg(F.avg("n").alias("mean")), of_class.groupBy("term").agg(F.sum("cf").alias("ft"))
    idf = total.join(F.broadcast(mean)).select("term", F.log(1 + F.col("mean") / F.col("ft")).alias("idf"))  # a one-row mean
    topic = of_class.join(size, "class").join(idf, "term").select("class", "term", "idf", (F.col("cf") / F.col("n") * F.col("idf")).alias("w"))
    norm = topic.groupBy("class").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("cn"))
    x = tf.join(topic, ["class", "term"]).withColumn("dw", F.col("f") * F.col("idf"))
    per = x.groupBy("class", "row_id").agg(F.sum(F.col("dw") * F.col("w")).alias("dot"), F.sqrt(F.sum(F.col("dw") * F.col("dw"))).alias("dn"))
    per = per.join(norm, "class").withColumn("cosine", F.round(F.col("dot") / (F.col("dn") * F.col("cn")), 6))
    return per.withColumn("k", F.row_number().over(W.partitionBy("class").orderBy(F.desc("cosine"), "row_id"))).where("k <= 5").select("class", "row_id", "cosine", "k")


def topic_cards(spark, d):
    """Every assigned topic with its size, label and its ten keywords (none where it has none)."""
    n = _assigned(spark, d).groupBy(*TOPIC).agg(F.count("*").alias("size"))
    kw = table(spark, d, "topic_keywords", "run_id", "univ_code", F.col("topic_id").try_cast("int").alias("topic_id"), "kw_rank", "word").where("word IS NOT NULL AND kw_rank <= 10")
    kw = kw.groupBy(*TOPIC).agg(F.transform(F.array_sort(F.collect_list(F.struct("kw_rank", "word"))), lambda x: F.lower(F.trim(x["word"]))).alias("ws"))
    j = n.join(_labels(spark, d).select(*TOPIC, "label"), TOPIC, "left").join(kw, TOPIC, "left")
    return j.select(*TOPIC, "size", "label", F.coalesce(F.array_join("ws", ","), F.lit("")).alias("keywords"))


def retry_queue(spark, d):
    """Posts to be scored again: those whose last try brought no full score, the latest failure each, at most 5,000, the
    newest failures kept; with the number of failed tries."""
    full = F.col("v").isNotNull() & F.col("a").isNotNull() & F.col("d").isNotNull()
    s = _scores(spark, d).where("scored_at IS NOT NULL").withColumn("full", full)
    g = s.groupBy("post_id").agg(F.count_if(~F.col("full")).alias("n_failed"), F.max(F.when(~F.col("full"), F.col("scored_at"))).alias("failed_at"), F.max(F.when(F.col("full"), F.col("scored_at"))).alias("done_at"))
    open_ = g.where("n_failed > 0 AND (done_at IS NULL OR done_at < failed_at)")
    return open_.orderBy(F.desc("failed_at"), "post_id").limit(5000).select("post_id", "n_failed", F.unix_seconds("failed_at").alias("failed_s"))


def recovered(spark, d):
    """Per university: posts that failed at some time, those scored in full later, and those given up."""
    full = F.col("v").isNotNull() & F.col("a").isNotNull() & F.col("d").isNotNull()
    s = _scores(spark, d).where("scored_at IS NOT NULL").withColumn("full", full)
    g = s.groupBy("univ_code", "post_id").agg(F.count_if(~F.col("full")).alias("k"), F.max(F.when(~F.col("full"), F.col("scored_at"))).alias("f"), F.max(F.when(F.col("full"), F.col("scored_at"))).alias("ok"))
    later = F.coalesce(F.col("ok") >= F.col("f"), F.lit(False))
    return g.where("k > 0").groupBy("univ_code").agg(F.count("*").alias("n_failed"), F.count_if(later).alias("n_recovered"), F.count_if(~later).alias("n_open"))


def feed_cursor(spark, d):
    """Pages of fifty posts of every source with the cursor after each, its advance, and whether the feed ends there."""
    p = table(spark, d, "golden_input", "_test_source_code", "row_id", "post_id").withColumnRenamed("_test_source_code", "source_code")
    page = F.floor((F.row_number().over(W.partitionBy("source_code").orderBy("row_id")) - 1) / 50).cast("int")
    g = p.withColumn("page", page).groupBy("source_code", "page").agg(F.max("row_id").alias("cursor"), F.count("*").alias("n"))
    w = W.partitionBy("source_code").orderBy("page")
    return g.select("source_code", "page", "cursor", (F.col("cursor") - F.coalesce(F.lag("cursor").over(w), F.lit(0))).alias("advance"), F.lead("page").over(w).isNull().alias("end_of_feed"))


def best_copies(spark, d):
    """Of the copies of a post that of greatest priority (by how it was scraped), the latest among equals."""
    rank = F.when(F.col("source") == "graphql", 2).when(F.col("source").isNotNull(), 1).otherwise(0)
    p = table(spark, d, "golden_input", "post_id", "row_id", "source")
    return p.groupBy("post_id").agg(F.max_by(F.struct("row_id", "source"), F.struct(rank, "row_id")).alias("b")).select("post_id", "b.row_id", "b.source")


def batch_minutes(spark, d):
    """Batches of five and minutes at twenty requests a minute for every university."""
    n = _assigned(spark, d).select("univ_code", "post_id").distinct().groupBy("univ_code").agg(F.count("*").alias("n"))
    b = F.ceil(F.col("n") / 5).cast("bigint")
    return n.select("univ_code", "n", b.alias("batches"), F.round(b / 20, 2).alias("minutes"))


def hue_bands(spark, d):
    """Latest scores by valence band and place on the scale of nine hues."""
    s = _latest(spark, d)
    hue = F.when(F.col("v").isNotNull(), F.least(F.greatest(F.col("v") - 1, F.lit(0)), F.lit(8)))
    return s.groupBy(valence_band(F.col("v")).alias("band"), hue.alias("hue")).agg(F.count("*").alias("n"))


def _volume(spark, d, least: int):
    n = table(spark, d, "golden_input", "_test_source_code").groupBy(F.col("_test_source_code").alias("source_code")).agg(F.count("*").alias("n"))
    return n.select("source_code", "n", (F.col("n") < least).alias("skipped"))


def least_volume(spark, d):
    """Sources with too few posts for topics: under 1,000."""
    return _volume(spark, d, 1000)


def least_volume_small(spark, d):
    return _volume(spark, d, 150)


def heatmap_fifty(spark, d):
    """Mean scores of labels with fifty scores or more, the most negative first."""
    s = _latest(spark, d).where("v IS NOT NULL AND topic_label IS NOT NULL AND lower(topic_label) <> 'noise' AND topic_label <> ''").groupBy("topic_label").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in "vad"])
    return s.where("n >= 50").orderBy("mean_v", "topic_label")


def winner(spark, d):
    """Which of two model versions wins: the second only if better by five per cent or more on both full rate and mean topics
    covered per university."""
    s = _scores(spark, d).withColumn("full", (F.col("v").isNotNull() & F.col("a").isNotNull() & F.col("d").isNotNull()).cast("int"))
    g = s.groupBy("model_version").agg(F.round(F.avg("full"), 6).alias("full_rate"), F.count_distinct("univ_code", "topic_id").alias("n_topics"))
    one = g.agg(*[F.max(F.when(F.col("model_version") == f"mock-70b-v{k}", F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("full_rate", "n_topics")])
    better = (F.col("full_rate_2") >= 1.05 * F.col("full_rate_1")) & (F.col("n_topics_2") >= 1.05 * F.col("n_topics_1"))
    return one.withColumn("winner", F.when(better, "mock-70b-v2").otherwise("mock-70b-v1"))


def glossary(spark, d):
    """Sources and regions as one sorted list of terms with what they mean, a map's entries per row."""
    r = table(spark, d, "source_ref", "source_code", "region_label", "tz_name")
    m = r.select(F.map_concat(F.create_map(F.col("source_code"), F.col("region_label")), F.create_map(F.concat("source_code", F.lit(" zone")), F.col("tz_name"))).alias("m"))
    flat = m.select(F.explode(F.array_sort(F.map_entries("m"))).alias("e")).select("e.key", "e.value").distinct()
    return flat.select(F.col("key").alias("term"), F.col("value").alias("meaning")).orderBy("term")


def answer_repairs(spark, d):
    """Scores written as broken JSON (single quotes, trailing commas, a missing end, bare words of truth) and read again."""
    s = _scores(spark, d).where("v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL AND post_id IS NOT NULL").select("post_id", "v", "a", "d", F.coalesce("sarcasm", F.lit(False)).alias("s")).distinct()
    kinds = {
        "single_quotes": F.format_string("[{'id': '%s', 'V': %d, 'A': %d, 'D': %d, 'sarcasm': False}]", "post_id", "v", "a", "d"),
        "trailing_commas": F.format_string('[{"id": "%s", "V": %d, "A": %d, "D": %d,},]', "post_id", "v", "a", "d"),
        "no_end": F.format_string('[{"id": "%s", "V": %d, "A": %d, "D": %d', "post_id", "v", "a", "d"),
        "bare_keys": F.format_string("Scores: [{id: '%s', V: %d, A: %d, D: %d}] done", "post_id", "v", "a", "d"),
        "beyond_repair": F.format_string("%s: V %d A %d D %d", "post_id", "v", "a", "d"),
    }
    each = s.select("v", "a", "d", F.explode(F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k), c)])).alias("kind", "text"))
    p = each.withColumn("r", parse_answer(F.col("text"), repair=True))
    same = F.coalesce((F.size("r") == 1) & (F.col("r")[0]["v"] == F.col("v")) & (F.col("r")[0]["a"] == F.col("a")) & (F.col("r")[0]["d"] == F.col("d")), F.lit(False))
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


QUERIES = {
    f.__name__: f
    for f in (
        assessment_checks, label_flags, grid_choice, gold_agreement, class_ngrams, representative_posts, topic_cards, retry_queue, recovered, feed_cursor, best_copies, batch_minutes,
        hue_bands, least_volume, least_volume_small, heatmap_fifty, winner, glossary, answer_repairs,
    )
}

_ORD = ", ".join(f"{c} NULLS FIRST" for c in ORDER)
_LATEST = f"s AS (SELECT * FROM vad_score QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY scored_at DESC NULLS LAST, {_ORD}) = 1)"
_FULL = "v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL"
_NPMI = f"cn AS (SELECT split_part(class, '/', 1) AS univ_code, split_part(class, '/', 2)::INT AS topic_id, npmi FROM ({topics.SQL['class_npmi']}))"
_STOPS = ", ".join(f"'{w}'" for w in STOP)
_OUT = "o AS (SELECT univ_code, count(*) AS n_posts, round(avg((topic_id = -1)::INT), 4) AS outlier_rate FROM topic_assignments GROUP BY 1)"
_VOLUME = "SELECT _test_source_code AS source_code, count(*) AS n, count(*) < {n} AS skipped FROM golden_input GROUP BY 1"
SQL = {
    "assessment_checks": f"""WITH {_NPMI}, {_OUT}, {topics._LAB},
        b AS (SELECT univ_code, count(*) FILTER (n >= 10) AS n_big FROM (SELECT univ_code, count(*) AS n FROM topic_assignments WHERE topic_id <> -1 GROUP BY run_id, univ_code, topic_id) GROUP BY 1),
        l AS (SELECT univ_code, round(avg(coalesce(list_contains(flags, 'lazy'), false)::INT), 4) AS lazy, count(*) AS n_labels, count(DISTINCT prompt_sha256) AS n_cached, count(DISTINCT response_meta.model) AS n_models FROM lab GROUP BY 1),
        c AS (SELECT univ_code, round(avg(npmi), 3) AS npmi FROM cn GROUP BY 1),
        j AS (SELECT o.univ_code, n_posts, outlier_rate, outlier_rate <= {HIGH_OUTLIERS} AS outlier_rate_ok, coalesce(n_big, 0) >= {LEAST_TOPICS} AS min_topics_ok, coalesce(lazy, 0) <= {MOST_LAZY} AS lazy_label_ok,
          coalesce(npmi, 0) >= {LEAST_NPMI} AS npmi_ok, coalesce(n_cached, 0) = coalesce(n_labels, 0) AS cache_count_matches, coalesce(n_models, 0) > 1 AS model_version_drift
          FROM o LEFT JOIN b USING (univ_code) LEFT JOIN l USING (univ_code) LEFT JOIN c USING (univ_code))
        SELECT *, NOT (outlier_rate_ok AND min_topics_ok AND lazy_label_ok AND npmi_ok AND cache_count_matches) AS needs_review FROM j""",
    "label_flags": f"""WITH {_OUT}, {topics._LAB}, l AS (SELECT * FROM lab WHERE label IS NOT NULL), sh AS (SELECT label FROM l WHERE label <> 'Unlabeled' GROUP BY 1 HAVING count(DISTINCT univ_code) > 1)
        SELECT 'outliers' AS flag, univ_code, NULL::INT AS topic_id, outlier_rate::VARCHAR AS what FROM o WHERE outlier_rate > 0.1
        UNION ALL SELECT 'lazy', univ_code, topic_id, label FROM l WHERE list_contains(flags, 'lazy') UNION ALL SELECT 'shared', univ_code, topic_id, label FROM l JOIN sh USING (label)""",
    "grid_choice": f"""WITH {_NPMI}, r AS (SELECT univ_code, run_id, avg((topic_id = -1)::INT) AS o, count(DISTINCT topic_id) FILTER (topic_id >= 0) AS n_clusters FROM topic_assignments GROUP BY 1, 2),
        m AS (SELECT a.univ_code, a.run_id, avg(npmi) AS npmi FROM (SELECT DISTINCT univ_code, run_id, topic_id FROM topic_assignments) a JOIN cn USING (univ_code, topic_id) GROUP BY 1, 2),
        s AS (SELECT r.*, round({WEIGHTS["npmi"]} * coalesce(npmi, 0) + {WEIGHTS["low_outliers"]} * (1 - o), 4) AS score FROM r LEFT JOIN m USING (univ_code, run_id))
        SELECT univ_code, run_id, n_clusters, score, n_clusters < 4 AS below_floor FROM s QUALIFY row_number() OVER (PARTITION BY univ_code ORDER BY n_clusters >= 4 DESC, score DESC, run_id) = 1""",
    "gold_agreement": f"""WITH f AS (SELECT * FROM vad_score WHERE {_FULL} AND sarcasm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post_id, model_version ORDER BY scored_at DESC NULLS LAST, {_ORD}) = 1),
        j AS (SELECT x.post_id, x.v AS v1, y.v AS v2, x.a AS a1, y.a AS a2, x.d AS d1, y.d AS d2, x.sarcasm::INT AS s1, y.sarcasm::INT AS s2, x.topic_label IS NOT DISTINCT FROM y.topic_label AS l
          FROM f x JOIN f y USING (post_id) WHERE x.model_version = 'mock-70b-v1' AND y.model_version = 'mock-70b-v2'),
        g AS (SELECT count(*) AS n, {", ".join(f"round(avg((abs({c}1 - {c}2) <= 1)::INT), 4) AS {c}_within_1, round(corr({c}1, {c}2), 4) AS {c}_pearson" for c in "vad")},
          round(avg((abs(v1 - v2) <= 1 AND abs(a1 - a2) <= 1 AND abs(d1 - d2) <= 1)::INT), 4) AS joint_within_1, avg((s1 = s2)::INT) AS po, avg(s1) * avg(s2) + (1 - avg(s1)) * (1 - avg(s2)) AS pe,
          round(avg(l::INT), 4) AS label_agreement, count(*) FILTER (left(md5(post_id), 2) < '0d') AS n_sample FROM j)
        SELECT * EXCLUDE (po, pe), round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 4) AS kappa FROM g""",
    "class_ngrams": topics._CLASS
    + f""", k AS (SELECT class, list_filter(ts, lambda t: length(t) >= 2 AND t NOT IN ({_STOPS})) AS ts FROM c),
        t AS (SELECT class, unnest(ts) AS term FROM k UNION ALL SELECT class, ts[i] || ' ' || ts[i + 1] FROM (SELECT class, ts, unnest(generate_series(1, len(ts) - 1)) AS i FROM k)),
        tf AS (SELECT class, term, count(*) AS f FROM t GROUP BY ALL), sz AS (SELECT class, sum(f) AS n FROM tf GROUP BY 1), av AS (SELECT avg(n) AS a FROM sz), ft AS (SELECT term, sum(f) AS ft FROM tf GROUP BY 1)
        SELECT class, term, round(f / n * ln(1 + a / ft), 6) AS score FROM tf JOIN sz USING (class) JOIN ft USING (term) CROSS JOIN av
        QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(f / n * ln(1 + a / ft), 9) DESC, term) <= 10""",
    "representative_posts": topics._CLASS
    + f""", t AS (SELECT class, row_id, term, count(*) AS f FROM w WHERE length(term) >= 2 AND term NOT IN ({_STOPS}) GROUP BY ALL), cf AS (SELECT class, term, sum(f) AS cf FROM t GROUP BY ALL),
        sz AS (SELECT class, sum(cf) AS n FROM cf GROUP BY 1), av AS (SELECT avg(n) AS a FROM sz), ix AS (SELECT term, ln(1 + any_value(a) / sum(cf)) AS idf FROM cf CROSS JOIN av GROUP BY term),
        tp AS (SELECT class, term, idf, cf / n * idf AS w FROM cf JOIN sz USING (class) JOIN ix USING (term)), nm AS (SELECT class, sqrt(sum(w * w)) AS cn FROM tp GROUP BY 1),
        pr AS (SELECT class, row_id, round(sum(f * idf * tp.w) / (sqrt(sum(f * idf * f * idf)) * any_value(cn)), 6) AS cosine FROM t JOIN tp USING (class, term) JOIN nm USING (class) GROUP BY class, row_id)
        SELECT class, row_id, cosine, row_number() OVER (PARTITION BY class ORDER BY cosine DESC, row_id) AS k FROM pr QUALIFY k <= 5""",
    "topic_cards": f"""WITH {topics._LAB}, n AS (SELECT run_id, univ_code, topic_id, count(*) AS size FROM topic_assignments GROUP BY ALL),
        k AS (SELECT run_id, univ_code, try_cast(topic_id AS INT) AS topic_id, string_agg(lower(trim(word, ' ')), ',' ORDER BY kw_rank, word) AS keywords FROM topic_keywords WHERE word IS NOT NULL AND kw_rank <= 10 GROUP BY ALL)
        SELECT n.*, lab.label, coalesce(keywords, '') AS keywords FROM n LEFT JOIN lab USING (run_id, univ_code, topic_id) LEFT JOIN k USING (run_id, univ_code, topic_id)""",
    "retry_queue": f"""SELECT post_id, count(*) FILTER (NOT ({_FULL})) AS n_failed, floor(epoch(max(scored_at) FILTER (NOT ({_FULL}))))::BIGINT AS failed_s FROM vad_score WHERE scored_at IS NOT NULL GROUP BY 1
        HAVING n_failed > 0 AND coalesce(max(scored_at) FILTER ({_FULL}) < max(scored_at) FILTER (NOT ({_FULL})), true) ORDER BY max(scored_at) FILTER (NOT ({_FULL})) DESC, post_id LIMIT 5000""",
    "recovered": f"""WITH g AS (SELECT univ_code, post_id, count(*) FILTER (NOT ({_FULL})) AS k, coalesce(max(scored_at) FILTER ({_FULL}) >= max(scored_at) FILTER (NOT ({_FULL})), false) AS ok FROM vad_score WHERE scored_at IS NOT NULL GROUP BY 1, 2)
        SELECT univ_code, count(*) AS n_failed, count(*) FILTER (ok) AS n_recovered, count(*) FILTER (NOT ok) AS n_open FROM g WHERE k > 0 GROUP BY 1""",
    "feed_cursor": """WITH p AS (SELECT _test_source_code AS source_code, row_id, ((row_number() OVER (PARTITION BY _test_source_code ORDER BY row_id) - 1) // 50)::INT AS page FROM golden_input),
        g AS (SELECT source_code, page, max(row_id) AS cursor FROM p GROUP BY 1, 2)
        SELECT source_code, page, cursor, cursor - coalesce(lag(cursor) OVER w, 0) AS advance, lead(page) OVER w IS NULL AS end_of_feed FROM g WINDOW w AS (PARTITION BY source_code ORDER BY page)""",
    "best_copies": "SELECT post_id, row_id, source FROM golden_input QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY CASE WHEN source = 'graphql' THEN 2 WHEN source IS NOT NULL THEN 1 ELSE 0 END DESC, row_id DESC) = 1",
    "batch_minutes": "SELECT univ_code, count(DISTINCT post_id) AS n, ceil(count(DISTINCT post_id) / 5)::BIGINT AS batches, round(ceil(count(DISTINCT post_id) / 5) / 20, 2) AS minutes FROM topic_assignments GROUP BY 1",
    "hue_bands": f"WITH {_LATEST} SELECT CASE WHEN v <= 3 THEN 'low' WHEN v <= 6 THEN 'middle' WHEN v IS NOT NULL THEN 'high' END AS band, CASE WHEN v IS NOT NULL THEN least(greatest(v - 1, 0), 8) END AS hue, count(*) AS n FROM s GROUP BY 1, 2",
    "least_volume": _VOLUME.format(n=1000),
    "least_volume_small": _VOLUME.format(n=150),
    "heatmap_fifty": f"""WITH {_LATEST} SELECT topic_label, count(*) AS n, {", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in "vad")} FROM s
        WHERE v IS NOT NULL AND topic_label IS NOT NULL AND lower(topic_label) <> 'noise' AND topic_label <> '' GROUP BY 1 HAVING count(*) >= 50""",
    "winner": f"""WITH g AS (SELECT model_version, round(avg(({_FULL})::INT), 6) AS full_rate, count(DISTINCT (univ_code, topic_id)) FILTER (univ_code IS NOT NULL AND topic_id IS NOT NULL) AS n_topics FROM vad_score GROUP BY 1),
        o AS (SELECT {", ".join(f"max({c}) FILTER (model_version = 'mock-70b-v{k}') AS {c}_{k}" for k in (1, 2) for c in ("full_rate", "n_topics"))} FROM g)
        SELECT *, CASE WHEN full_rate_2 >= 1.05 * full_rate_1 AND n_topics_2 >= 1.05 * n_topics_1 THEN 'mock-70b-v2' ELSE 'mock-70b-v1' END AS winner FROM o""",
    "glossary": "SELECT source_code AS term, region_label AS meaning FROM source_ref UNION SELECT source_code || ' zone', tz_name FROM source_ref",
    "answer_repairs": f"""WITH s AS (SELECT DISTINCT post_id, v, a, d, coalesce(sarcasm, false) AS s FROM vad_score WHERE {_FULL} AND post_id IS NOT NULL), n AS (SELECT count(*) AS n FROM s)
        SELECT k AS kind, n, CASE WHEN k = 'beyond_repair' THEN 0 ELSE n END AS n_same FROM n, unnest(['single_quotes', 'trailing_commas', 'no_end', 'bare_keys', 'beyond_repair']) AS t(k)""",
    "balanced_plan": """WITH RECURSIVE o AS (SELECT univ_code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, univ_code) AS i FROM topic_assignments WHERE univ_code IS NOT NULL GROUP BY 1),
        r AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS univ_code, -1 AS worker, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS load
          UNION ALL SELECT o.i, o.univ_code, (list_position(load, list_min(load)) - 1)::INT, list_transform(load, lambda x, k: CASE WHEN k = list_position(load, list_min(load)) THEN x + o.n ELSE x END) FROM r JOIN o ON o.i = r.i + 1)
        SELECT univ_code, worker, load[worker + 1] AS load FROM r WHERE i > 0""",
}
