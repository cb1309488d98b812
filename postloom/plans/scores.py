"""Scores of posts: latest, checked, aggregated, reconciled, compared."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions.numbers import quadrant, tone, upper_median, valence_band
from postloom.io import table
from postloom.operators.dedup import keep_first
from postloom.operators.joins import reconcile
from postloom.operators.scores import agreement, checked, largest_first, parse_answer

ORDER = ["researcher_id", "model_version", "v", "a", "d", "topic_id", "univ_code"]


def _scores(spark: SparkSession, d: str):
    return table(spark, d, "vad_score")


def _latest(spark, d):
    return keep_first(_scores(spark, d), ["post_id"], [F.desc("scored_at"), *[F.asc(c) for c in ORDER]])


def latest_score(spark, d):
    return _latest(spark, d).select("post_id", F.unix_micros("scored_at").alias("scored_us"), "v", "a", "d")


def checked_scores(spark, d):
    return checked(_scores(spark, d).select("post_id", "scored_at", "v", "a", "d", "sarcasm", "flags")).select("v", "a", "d", F.array_join("flags", ",").alias("flags")).groupBy("v", "a", "d", "flags").agg(F.count("*").alias("n"))


def topic_statistics(spark, d):
    """Per university and topic label: count, mean, interpolated median, sarcasm and flags of the latest scores."""
    s = _latest(spark, d)
    stats = [x for c in "vad" for x in (F.round(F.avg(c), 3).alias(f"{c}_mean"), F.round(F.median(c), 3).alias(f"{c}_median"))]
    main = s.groupBy("univ_code", "topic_label").agg(F.count("*").alias("n"), *stats, F.round(100 * F.avg(F.coalesce(F.col("sarcasm"), F.lit(False)).cast("int")), 2).alias("sarcasm_pct"))
    f = s.select("univ_code", "topic_label", F.explode("flags").alias("flag")).groupBy("univ_code", "topic_label", "flag").agg(F.count("*").alias("k"))
    f = f.groupBy("univ_code", "topic_label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flag", "k"))), lambda x: F.concat(x["flag"], F.lit(":"), x["k"].cast("string"))), ",").alias("flag_counts"))
    j = main.alias("m").join(f.alias("f"), F.col("m.univ_code").eqNullSafe(F.col("f.univ_code")) & F.col("m.topic_label").eqNullSafe(F.col("f.topic_label")), "left")
    return j.select("m.*", F.coalesce("f.flag_counts", F.lit("")).alias("flag_counts"))


def scored_topics(spark, d):
    """Per topic: posts, scored posts, means and sarcasm rate over the scored ones."""
    s = _latest(spark, d)
    full = F.col("v").isNotNull() & F.col("a").isNotNull() & F.col("d").isNotNull()
    means = [F.round(F.avg(F.when(full, F.col(c))), 2).alias(f"mean_{c}") for c in "vad"]
    return s.groupBy("univ_code", "topic_id").agg(F.count("*").alias("size"), F.count_if(full).alias("scored"), *means, F.round(F.avg(F.when(full, F.coalesce("sarcasm", F.lit(False)).cast("int"))), 3).alias("sarcasm_rate"))


def median_topic_sizes(spark, d):
    """Least, upper median and greatest number of scored posts per topic of every university."""
    n = _latest(spark, d).groupBy("univ_code", "topic_id").agg(F.count("*").alias("n"))
    return n.groupBy("univ_code").agg(F.min("n").alias("least"), upper_median(F.collect_list("n")).alias("upper_median"), F.max("n").alias("most"))


def heatmap(spark, d):
    """Mean scores of labels with ten scores or more, the most negative first."""
    s = _latest(spark, d).where("v IS NOT NULL AND topic_label <> '' AND lower(topic_label) <> 'noise'")
    return s.groupBy("univ_code", "topic_label").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in "vad"]).where("n >= 10").orderBy("mean_v", "univ_code", "topic_label")


def score_bands(spark, d):
    s = _latest(spark, d)
    return s.groupBy(valence_band(F.col("v")).alias("band"), quadrant(F.col("a"), F.col("d")).alias("quadrant"), F.when(F.col("sarcasm"), tone(F.col("v"))).alias("tone")).agg(F.count("*").alias("n"))


def schema_checks(spark, d):
    """Rows by the first thing wrong with them: a missing field, or a score out of range or not set."""
    s = _scores(spark, d)
    required = ["post_id", "univ_code", "topic_label", "researcher_id", "model_version", "scored_at"]
    issue = None
    for c in required:
        hit = F.when(F.col(c).isNull(), f"missing_{c}")
        issue = hit if issue is None else F.coalesce(issue, hit)
    for c in "vad":
        issue = F.coalesce(issue, F.when(F.col(c).isNull(), f"{c}_null").when(~F.col(c).between(1, 9), f"{c}_out_of_range"))
    return s.groupBy(F.coalesce(issue, F.lit("valid")).alias("issue")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def reconciled(spark, d):
    r = reconcile(table(spark, d, "topic_assignments", "post_id"), _scores(spark, d).select("post_id", "scored_at", *ORDER), "post_id", [F.desc("scored_at"), *[F.asc(c) for c in ORDER]])
    return r.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_got").alias("n_answers"))


def pending(spark, d):
    """Assigned posts that have no score yet, by university."""
    a = table(spark, d, "topic_assignments", "post_id", "univ_code").distinct()
    return a.join(_scores(spark, d).select("post_id"), "post_id", "left_anti").groupBy("univ_code").agg(F.count("*").alias("n"))


def batches_of_five(spark, d):
    """Rows of each university in fives, in order of their posts."""
    a = table(spark, d, "topic_assignments", "post_id", "univ_code", "run_id", "topic_id", "probability").select("post_id", "univ_code").distinct()
    k = F.row_number().over(W.partitionBy("univ_code").orderBy("post_id"))
    return a.select("univ_code", "post_id", F.floor((k - 1) / 5).cast("bigint").alias("batch"))


def rescored_agreement(spark, d):
    """How well the first and the last score of posts scored again agree."""
    s = _scores(spark, d).where("v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL AND sarcasm IS NOT NULL AND scored_at IS NOT NULL")
    keep = lambda order: keep_first(s, ["post_id"], order).select("post_id", "v", "a", "d", "sarcasm", "scored_at")
    first = keep([F.asc("scored_at"), *[F.asc(c) for c in ORDER]])
    last = keep([F.desc("scored_at"), *[F.desc(c) for c in ORDER]])
    j = first.alias("x").join(last.alias("y"), "post_id").where("x.scored_at < y.scored_at")
    j = j.select(*[F.col(f"x.{c}").alias(f"{c}1") for c in ("v", "a", "d", "sarcasm")], *[F.col(f"y.{c}").alias(f"{c}2") for c in ("v", "a", "d", "sarcasm")])
    out = agreement(j, {c: (f"{c}1", f"{c}2") for c in "vad"}, ("sarcasm1", "sarcasm2"))
    return out.select(*[F.round(c, 4).alias(c) if c != "n" else "n" for c in out.columns])


def answer_round_trip(spark, d):
    """Scores written as the answers of a model (bare, in prose, single, as text) and parsed again."""
    s = _scores(spark, d).where("v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL").select("post_id", "v", "a", "d", F.coalesce("sarcasm", F.lit(False)).alias("s"), "scored_at").distinct()
    record = F.format_string('{"id": "%s", "V": %d, "A": "%d", "D": %d, "sarcasm": %s}', "post_id", "v", "a", "d", F.when(F.col("s"), F.lit('"yes"')).otherwise(F.lit("false")))
    kind = F.pmod(F.crc32("post_id"), F.lit(4))
    text = (
        F.when(kind == 0, F.concat(F.lit("["), record, F.lit("]"))).when(kind == 1, record)
        .when(kind == 2, F.concat(F.lit("Here are the scores:\n["), record, F.lit("]\nDone."))).otherwise(F.concat(F.lit("no scores: "), record))
    )
    p = s.select(kind.alias("kind"), "v", "a", "d", "s", parse_answer(text).alias("r"))
    same = F.coalesce((F.col("r")[0]["v"] == F.col("v")) & (F.col("r")[0]["a"] == F.col("a")) & (F.col("r")[0]["d"] == F.col("d")) & (F.col("r")[0]["sarcasm"] == F.col("s")), F.lit(False))
    return p.groupBy(F.col("kind").cast("int").alias("kind")).agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"), F.count_if(F.col("r").isNull()).alias("n_unreadable"))


def balanced_plan(spark, d):
    """Universities spread over four workers by their posts, the largest first."""
    n = table(spark, d, "topic_assignments", "univ_code").groupBy("univ_code").agg(F.count("*").alias("n"))
    rows = largest_first([(r.univ_code, float(r.n)) for r in n.where("univ_code IS NOT NULL").toLocalIterator()], 4)  # one per university
    return spark.createDataFrame(rows or [("", 0, 0.0)], "univ_code string, worker int, load double").where("univ_code <> ''")


QUERIES = {
    f.__name__: f
    for f in (
        latest_score, checked_scores, topic_statistics, scored_topics, median_topic_sizes, heatmap, score_bands, schema_checks, reconciled, pending, batches_of_five,
        rescored_agreement, answer_round_trip, balanced_plan,
    )
}

_ORD = ", ".join(f"{c} NULLS FIRST" for c in ORDER)
_LATEST = f"s AS (SELECT * FROM vad_score QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY scored_at DESC NULLS LAST, {_ORD}) = 1)"
_FULL = "v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL"
SQL = {
    "latest_score": f"WITH {_LATEST} SELECT post_id, epoch_us(scored_at) AS scored_us, v, a, d FROM s",
    "checked_scores": """WITH c AS (SELECT coalesce(least(greatest(v, 1), 9), 1) AS v, coalesce(least(greatest(a, 1), 9), 1) AS a, coalesce(least(greatest(d, 1), 9), 1) AS d,
          array_to_string(list_concat(list_filter([CASE WHEN coalesce(v NOT BETWEEN 1 AND 9, true) OR coalesce(a NOT BETWEEN 1 AND 9, true) OR coalesce(d NOT BETWEEN 1 AND 9, true) THEN 'range_clamped' END,
            CASE WHEN v IS NULL THEN 'v_missing' WHEN v NOT BETWEEN 1 AND 9 THEN 'v_clamped' END, CASE WHEN a IS NULL THEN 'a_missing' WHEN a NOT BETWEEN 1 AND 9 THEN 'a_clamped' END,
            CASE WHEN d IS NULL THEN 'd_missing' WHEN d NOT BETWEEN 1 AND 9 THEN 'd_clamped' END, CASE WHEN sarcasm AND coalesce(least(greatest(v, 1), 9), 1) >= 7 THEN 'sarcasm_high_valence' END], lambda x: x IS NOT NULL), coalesce(flags, [])), ',') AS flags FROM vad_score)
        SELECT v, a, d, coalesce(flags, '') AS flags, count(*) AS n FROM c GROUP BY ALL""",
    "topic_statistics": f"""WITH {_LATEST}, f AS (SELECT univ_code, topic_label, flag, count(*) AS k FROM (SELECT univ_code, topic_label, unnest(flags) AS flag FROM s) GROUP BY ALL),
        g AS (SELECT univ_code, topic_label, string_agg(flag || ':' || k, ',' ORDER BY flag, k) AS flag_counts FROM f GROUP BY ALL),
        m AS (SELECT univ_code, topic_label, count(*) AS n, round(avg(v), 3) AS v_mean, round(median(v), 3) AS v_median, round(avg(a), 3) AS a_mean, round(median(a), 3) AS a_median, round(avg(d), 3) AS d_mean, round(median(d), 3) AS d_median,
          round(100 * avg(coalesce(sarcasm, false)::INT), 2) AS sarcasm_pct FROM s GROUP BY ALL)
        SELECT m.*, coalesce(g.flag_counts, '') AS flag_counts FROM m LEFT JOIN g ON m.univ_code IS NOT DISTINCT FROM g.univ_code AND m.topic_label IS NOT DISTINCT FROM g.topic_label""",
    "scored_topics": f"""WITH {_LATEST} SELECT univ_code, topic_id, count(*) AS size, count(*) FILTER ({_FULL}) AS scored, round(avg(v) FILTER ({_FULL}), 2) AS mean_v, round(avg(a) FILTER ({_FULL}), 2) AS mean_a,
        round(avg(d) FILTER ({_FULL}), 2) AS mean_d, round(avg(coalesce(sarcasm, false)::INT) FILTER ({_FULL}), 3) AS sarcasm_rate FROM s GROUP BY ALL""",
    "median_topic_sizes": f"WITH {_LATEST}, n AS (SELECT univ_code, topic_id, count(*) AS n FROM s GROUP BY ALL), l AS (SELECT univ_code, list_sort(list(n)) AS l FROM n GROUP BY 1) SELECT univ_code, l[1] AS least, l[len(l) // 2 + 1] AS upper_median, l[len(l)] AS most FROM l",
    "heatmap": f"WITH {_LATEST} SELECT univ_code, topic_label, count(*) AS n, round(avg(v), 3) AS mean_v, round(avg(a), 3) AS mean_a, round(avg(d), 3) AS mean_d FROM s WHERE v IS NOT NULL AND topic_label <> '' AND lower(topic_label) <> 'noise' GROUP BY ALL HAVING count(*) >= 10",
    "score_bands": f"""WITH {_LATEST} SELECT CASE WHEN v <= 3 THEN 'low' WHEN v <= 6 THEN 'middle' WHEN v IS NOT NULL THEN 'high' END AS band,
        (CASE WHEN a >= 5 THEN 'H' WHEN a IS NOT NULL THEN 'L' END) || (CASE WHEN d >= 5 THEN 'H' WHEN d IS NOT NULL THEN 'L' END) AS quadrant,
        CASE WHEN sarcasm THEN CASE WHEN v <= 4 THEN 'negative' WHEN v >= 7 THEN 'ironic_praise' WHEN v IS NOT NULL THEN 'ambivalent' END END AS tone, count(*) AS n FROM s GROUP BY ALL""",
    "schema_checks": """WITH c AS (SELECT CASE WHEN post_id IS NULL THEN 'missing_post_id' WHEN univ_code IS NULL THEN 'missing_univ_code' WHEN topic_label IS NULL THEN 'missing_topic_label' WHEN researcher_id IS NULL THEN 'missing_researcher_id'
          WHEN model_version IS NULL THEN 'missing_model_version' WHEN scored_at IS NULL THEN 'missing_scored_at' WHEN v IS NULL THEN 'v_null' WHEN v NOT BETWEEN 1 AND 9 THEN 'v_out_of_range' WHEN a IS NULL THEN 'a_null'
          WHEN a NOT BETWEEN 1 AND 9 THEN 'a_out_of_range' WHEN d IS NULL THEN 'd_null' WHEN d NOT BETWEEN 1 AND 9 THEN 'd_out_of_range' ELSE 'valid' END AS issue FROM vad_score),
        g AS (SELECT issue, count(*) AS n FROM c GROUP BY 1) SELECT issue, n, round(n / sum(n) OVER (), 4) AS share FROM g""",
    "reconciled": """WITH e AS (SELECT DISTINCT post_id FROM topic_assignments), g AS (SELECT post_id, count(*) AS k FROM vad_score GROUP BY 1)
        SELECT CASE WHEN e.post_id IS NULL THEN 'extra' WHEN g.post_id IS NULL THEN 'missing' ELSE 'matched' END AS status, count(*) AS n, sum(coalesce(k, 0))::BIGINT AS n_answers FROM e FULL JOIN g ON e.post_id = g.post_id GROUP BY 1""",
    "pending": "SELECT univ_code, count(*) AS n FROM (SELECT DISTINCT post_id, univ_code FROM topic_assignments) a WHERE NOT EXISTS (SELECT 1 FROM vad_score s WHERE s.post_id = a.post_id) GROUP BY 1",
    "batches_of_five": "SELECT univ_code, post_id, (row_number() OVER (PARTITION BY univ_code ORDER BY post_id) - 1) // 5 AS batch FROM (SELECT DISTINCT univ_code, post_id FROM topic_assignments)",
    "rescored_agreement": f"""WITH s AS (SELECT * FROM vad_score WHERE {_FULL} AND sarcasm IS NOT NULL AND scored_at IS NOT NULL),
        f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY scored_at, {_ORD}) = 1),
        l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY scored_at DESC, {", ".join(f"{c} DESC NULLS LAST" for c in ORDER)}) = 1),
        j AS (SELECT f.v AS v1, f.a AS a1, f.d AS d1, f.sarcasm::INT AS s1, l.v AS v2, l.a AS a2, l.d AS d2, l.sarcasm::INT AS s2 FROM f JOIN l USING (post_id) WHERE f.scored_at < l.scored_at),
        g AS (SELECT count(*) AS n, avg((abs(v1 - v2) <= 1)::INT) AS v_within_1, corr(v1, v2) AS v_pearson, avg((abs(a1 - a2) <= 1)::INT) AS a_within_1, corr(a1, a2) AS a_pearson, avg((abs(d1 - d2) <= 1)::INT) AS d_within_1, corr(d1, d2) AS d_pearson,
          avg((abs(v1 - v2) <= 1 AND abs(a1 - a2) <= 1 AND abs(d1 - d2) <= 1)::INT) AS joint_within_1, avg((s1 = s2)::INT) AS po, avg(s1) * avg(s2) + (1 - avg(s1)) * (1 - avg(s2)) AS pe FROM j)
        SELECT n, round(v_within_1, 4) AS v_within_1, round(v_pearson, 4) AS v_pearson, round(a_within_1, 4) AS a_within_1, round(a_pearson, 4) AS a_pearson, round(d_within_1, 4) AS d_within_1, round(d_pearson, 4) AS d_pearson,
          round(joint_within_1, 4) AS joint_within_1, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 4) AS kappa FROM g""",
}
