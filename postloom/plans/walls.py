"""What a wall's pages show of its posts with their topics and scores: alerts, scopes, weekly figures, feeds, topics over time.

Every query works on one table of posts (``_wall``): the last copy of each post with its instant, its likeliest topic, that
topic's label and its latest score. Figures of the last days are anchored to the newest post of the wall. Posts without an
instant take no part in them; nulls of scores are no scores; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions.numbers import gini
from postloom.functions.times import valid_epoch
from postloom.io import table
from postloom.operators import windows as win
from postloom.operators.clusters import class_terms
from postloom.operators.dedup import keep_first
from postloom.plans import instants
from postloom.plans.posts import STOP
from postloom.plans.scores import ORDER, _latest
from postloom.plans.topics import TOPIC, _labels

DAY = 86_400
# Fixed value: what makes a topic an institution's concern.
CONCERN = (
    "complain|frustrat|issue|problem|concern|noise|dorm|residence|facility|infrastructure|toxic|abus|profess|faculty|staff|department|college|univers|campus|ground|rule|policy|"
    "food|canteen|cafeteria|service|wifi|internet|exam|grad|adminis|tuition|fee|enrol|enroll"
)
RANK = {"crit": 0, "warn-strong": 1, "warn": 2}
EARLIEST, LATEST = 1_577_836_800, 1_893_456_000  # bounds of instants taken as real: the years 2020 to 2029
KEYWORD, SCOPE_DAYS = "exam", 30
WIDE_DAYS = 270  # a second, wider span for figures of the last day, which few posts reach


def is_concern(label: Column) -> Column:
    return F.coalesce(label.rlike(f"(?i){CONCERN}"), F.lit(False))


def _wall(spark: SparkSession, d: str) -> DataFrame:
    posts = keep_first(table(spark, d, "golden_input", "post_id", "row_id", "text"), ["post_id"], [F.desc("row_id")])
    ts = instants.found(spark, d).select("row_id", valid_epoch(F.col("epoch_s"), EARLIEST, LATEST).alias("ts"))
    order = [F.desc_nulls_last("probability"), F.desc("run_id"), F.asc("topic_id"), F.asc("univ_code")]
    topics = keep_first(table(spark, d, "topic_assignments", "post_id", *TOPIC, "probability"), ["post_id"], order).drop("probability")
    scores = _latest(spark, d).select("post_id", "v", "a", "d", "sarcasm")
    j = posts.join(topics, "post_id").join(ts, "row_id", "left").join(_labels(spark, d).select(*TOPIC, "label"), TOPIC, "left").join(scores, "post_id", "left")
    shown = F.when(F.col("topic_id") == -1, "Noise").otherwise(F.coalesce("label", F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))))
    return j.select("univ_code", "run_id", "post_id", "row_id", "text", "ts", "topic_id", shown.alias("label"), "v", "a", "d", F.coalesce("sarcasm", F.lit(False)).alias("sarcasm"))


def _recent(wall: DataFrame, seconds: int = DAY) -> DataFrame:
    return win.anchored(wall.where("ts IS NOT NULL"), "ts", ["univ_code"]).where(F.col("age") <= seconds)


def _alerts(wall: DataFrame, seconds: int = DAY) -> DataFrame:
    """The four rules of a wall's last seconds as one union: univ_code, kind, topic_id, level, figure, n, concern."""
    recent = _recent(wall, seconds).withColumn("concern", is_concern(F.col("label")))
    of = lambda df, kind, topic, level, figure, concern: df.select("univ_code", F.lit(kind).alias("kind"), topic.cast("int").alias("topic_id"), level.alias("level"), F.round(figure, 4).alias("figure"), F.col("n"), concern.alias("concern"))
    none, no, yes = F.lit(None), F.lit(False), F.lit(True)
    scored = recent.where("a IS NOT NULL").groupBy("univ_code").agg(F.count("*").alias("n"), F.avg("a").alias("m"), F.count_if(F.expr("v <= 3 AND a >= 7")).alias("crisis"))
    intensity = of(scored.where("n >= 5 AND m > 6.2"), "intensity", none, F.lit("warn"), F.col("m"), no)
    crisis = scored.where("crisis >= 2").withColumn("n", F.col("crisis"))
    crisis = of(crisis, "crisis", none, F.when(F.col("n") >= 5, "crit").otherwise("warn-strong"), F.col("n").cast("double"), yes)
    topics = recent.groupBy("univ_code", "topic_id").agg(F.count("*").alias("n"), F.min("label").alias("label")).withColumn("all", F.sum("n").over(W.partitionBy("univ_code")))
    topics = topics.withColumn("share", F.col("n") / F.col("all")).withColumn("concern", is_concern(F.col("label"))).where("all >= 10 AND share >= 0.3 AND topic_id <> -1")
    school = F.col("concern")
    level = lambda extreme: F.when(school & extreme, "crit").when(school, "warn-strong").otherwise("warn")
    share = of(topics, "concentration", F.col("topic_id"), level(F.col("share") >= 0.45), F.col("share"), school)
    rates = wall.where("v IS NOT NULL").groupBy("univ_code", "topic_id").agg(F.count("*").alias("n"), F.avg(F.col("sarcasm").cast("int")).alias("rate"), F.min("label").alias("label"))
    rates = rates.where("n >= 30 AND rate > 0.15").withColumn("concern", is_concern(F.col("label")))
    sarcasm = of(rates, "sarcasm", F.col("topic_id"), level(F.col("rate") > 0.25), F.col("rate"), school)
    return intensity.unionByName(share).unionByName(sarcasm).unionByName(crisis)


def wall_alerts(spark, d, seconds: int = DAY):
    """All alerts of every wall, the worst first."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return _alerts(_wall(spark, d), seconds).withColumn("rank", rank[F.col("level")]).orderBy("univ_code", "rank", "kind", "topic_id")


def wide_alerts(spark, d):
    return wall_alerts(spark, d, WIDE_DAYS * DAY)


def alert_posts(spark, d):
    """The posts behind each alert of the wider span."""
    wall = _wall(spark, d)
    a = _alerts(wall, WIDE_DAYS * DAY).select("univ_code", "kind", F.col("topic_id").alias("alert_topic"))
    near = _recent(wall, WIDE_DAYS * DAY).select("univ_code", "post_id", F.lit(True).alias("recent"))
    p = wall.join(near, ["univ_code", "post_id"], "left").join(a, "univ_code")
    own = F.col("topic_id").eqNullSafe(F.col("alert_topic"))
    hit = (
        F.when(F.col("kind") == "sarcasm", own & F.col("sarcasm")).when(F.col("recent").isNull(), F.lit(False)).when(F.col("kind") == "concentration", own)
        .when(F.col("kind") == "crisis", (F.col("v") <= 3) & (F.col("a") >= 7)).otherwise(F.col("a").isNotNull())
    )
    return p.where(hit).select("univ_code", "kind", "alert_topic", "post_id")


def scoped_topics(spark, d):
    """Topics of the posts of a wall's last days that hold a keyword: size, scored posts, mean valence."""
    p = _recent(_wall(spark, d), SCOPE_DAYS * DAY).where(F.contains(F.lower("text"), F.lit(KEYWORD)))
    return p.groupBy("univ_code", "topic_id").agg(F.count("*").alias("size"), F.count("v").alias("scored"), F.round(F.avg("v"), 4).alias("mean_v"))


def topic_days(spark, d):
    """Posts, mean valence and most frequent topic of each day of a wall."""
    p = _wall(spark, d).where("ts IS NOT NULL").withColumn("day", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))
    days = p.groupBy("univ_code", "day").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean_v"))
    top = p.groupBy("univ_code", "day", "topic_id").agg(F.count("*").alias("k"))
    top = keep_first(top, ["univ_code", "day"], [F.desc("k"), F.asc("topic_id")]).select("univ_code", "day", F.col("topic_id").alias("top_topic"))
    return days.join(top, ["univ_code", "day"])


def wall_week(spark, d):
    """Posts, negative posts and sarcasm rate of a wall's last seven days and of the seven before."""
    p = win.anchored(_wall(spark, d).where("ts IS NOT NULL"), "ts", ["univ_code"]).where(F.col("age") < 14 * DAY)
    week = F.when(F.col("age") < 7 * DAY, "now").otherwise("before")
    return p.groupBy("univ_code", week.alias("week")).agg(
        F.count("*").alias("n"), F.count_if(F.expr("v <= 3")).alias("n_negative"), F.round(F.avg(F.when(F.col("v").isNotNull(), F.col("sarcasm").cast("int"))), 4).alias("sarcasm_rate")
    )


def wall_deltas(spark, d):
    """Change of mean valence and of sarcasm rate from week to week, null where either week has under 20 scored posts."""
    p = _wall(spark, d).where("ts IS NOT NULL")
    v = win.window_delta(p, "ts", F.col("v"), ["univ_code"]).select("univ_code", F.round("delta", 4).alias("v_delta"))
    s = win.window_delta(p, "ts", F.when(F.col("v").isNotNull(), F.col("sarcasm").cast("int")), ["univ_code"]).select("univ_code", F.round("delta", 4).alias("sarcasm_delta"))
    return v.join(s, "univ_code")


def day_shares(spark, d, seconds: int = DAY):
    """Topics with at least three tenths of a wall's last 24 hours, where these hold ten posts or more."""
    n = _recent(_wall(spark, d), seconds).groupBy("univ_code", "topic_id").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("univ_code")))
    return n.where("all >= 10 AND n / all >= 0.3").select("univ_code", "topic_id", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


def wide_shares(spark, d):
    return day_shares(spark, d, WIDE_DAYS * DAY)


def danger_driver(spark, d):
    """The topic with most posts of high arousal and low dominance (five or more) and its share of all of these, outliers included."""
    p = _wall(spark, d).where("a >= 5 AND d < 5").groupBy("univ_code", "topic_id").agg(F.count("*").alias("n"))
    p = p.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("univ_code")), 4)).where("topic_id <> -1 AND n >= 5")
    return keep_first(p, ["univ_code"], [F.desc("n"), F.asc("topic_id")]).select("univ_code", "topic_id", "n", "share")


def danger_posts(spark, d):
    """Posts in danger zone, crisis and negative range by wall."""
    p = _wall(spark, d)
    return p.groupBy("univ_code").agg(F.count_if(F.expr("a >= 5 AND d < 5")).alias("danger"), F.count_if(F.expr("v <= 3 AND a >= 7")).alias("crisis"), F.count_if(F.expr("v <= 3")).alias("negative"))


def _placed(p: DataFrame, keys: dict[str, list[Column]], most: int) -> DataFrame:
    out = None
    for name, order in keys.items():
        w = W.partitionBy("univ_code").orderBy(*order, "row_id")
        part = p.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("univ_code", F.lit(name).alias("sort_key"), "place", "post_id")
        out = part if out is None else out.unionByName(part)
    return out


def feed_sorts(spark, d):
    """A wall's feed in all four orders. The page takes the first 200 posts and sorts those: a limit before the sort."""
    p = _wall(spark, d).withColumn("k", F.row_number().over(W.partitionBy("univ_code").orderBy("row_id"))).where("k <= 200")
    ts = F.coalesce("ts", F.lit(0)).desc()
    return _placed(p, {"newest": [ts], "arousal": [F.coalesce("a", F.lit(-1)).desc()], "negative": [F.coalesce("v", F.lit(99)).asc()], "sarcasm": [F.col("sarcasm").desc(), ts]}, 200)


def browser_sorts(spark, d):
    """The post browser's page of 400 in each of its seven orders, descending."""
    n = lambda c: F.coalesce(c, F.lit(-99)).desc()
    keys = {"ts": [F.coalesce("ts", F.lit(0)).desc()], "text": [F.length("text").desc_nulls_last()], "topic": [F.col("topic_id").desc()], "sarc": [F.col("sarcasm").desc()], "v": [n("v")], "a": [n("a")], "d": [n("d")]}
    p = _wall(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    return _placed(p, keys, 400)


def first_sarcastic(spark, d):
    """The first twelve sarcastic posts of every wall, in order of arrival."""
    return _placed(_wall(spark, d).where("sarcasm"), {"arrival": []}, 12).select("univ_code", "place", "post_id")


def temporal_signatures(spark, d):
    """Of every topic: posts with an instant, Gini over all months of its run (months without posts as zero), the fewest
    months that hold seven tenths, and whether that makes it the trace of an event."""
    p = _wall(spark, d).withColumn("month", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM"))
    months = p.where("month IS NOT NULL").groupBy("run_id", "univ_code").agg(F.count_distinct("month").alias("months"))
    n = p.where("month IS NOT NULL").groupBy(*TOPIC, "month").agg(F.count("*").alias("n"))
    top = win.concentrated(n, TOPIC, "month", "n").groupBy(*TOPIC).agg(F.array_join(F.array_sort(F.collect_list("month")), ",").alias("concentrated_months"))
    g = n.groupBy(*TOPIC).agg(F.sum("n").alias("n_with_timestamp"), F.collect_list("n").alias("c")).join(months, ["run_id", "univ_code"])
    g = g.withColumn("g", gini(F.concat("c", F.array_repeat(F.lit(0).cast("bigint"), (F.col("months") - F.size("c")).cast("int")))))
    g = g.join(top, TOPIC).select(*TOPIC, "n_with_timestamp", F.round("g", 4).alias("gini"), (F.round("g", 9) >= 0.6).alias("is_event_driven"), "concentrated_months")
    rest = p.select(*TOPIC).distinct().join(g.select(*TOPIC), TOPIC, "left_anti")
    return g.unionByName(rest.select(*TOPIC, F.lit(0).cast("bigint").alias("n_with_timestamp"), F.lit(0.0).alias("gini"), F.lit(False).alias("is_event_driven"), F.lit("").alias("concentrated_months")))


def topics_over_time(spark, d):
    """Posts of every topic in bins of equal width over its wall's time span, as many bins as the wall has months, with the
    five heaviest terms of each topic and bin."""
    from postloom.functions.text import words

    p = _wall(spark, d).where("ts IS NOT NULL")
    span = p.groupBy("univ_code").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count_distinct(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")).alias("bins"))
    bin_ = F.least(F.floor((F.col("ts") - F.col("lo")) * F.col("bins") / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.col("bins") - 1).cast("int")
    b = p.join(span, "univ_code").withColumn("bin", bin_).withColumn("class", F.concat_ws("/", "univ_code", "topic_id", "bin"))
    n = b.groupBy("class", "univ_code", "topic_id", "bin").agg(F.count("*").alias("frequency"))
    tokens = b.select("class", F.filter(words(F.col("text"), "[a-z]+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOP)).alias("tokens"))
    terms = class_terms(tokens, "class", "tokens", 5).groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("o"), "term"))), lambda x: x["term"]), ",").alias("words"))
    return n.join(terms, "class", "left").select("univ_code", "topic_id", "bin", "frequency", F.coalesce("words", F.lit("")).alias("words"))


def aligned_vectors(spark, d):
    """A vector's first two coordinates beside each post, in the order of the posts; null where a post has none. ``aligned``
    tells whether all posts of the wall have one."""
    v = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("row_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"), F.round(F.get("embedding", F.lit(1)).cast("double"), 6).alias("y"))
    p = _wall(spark, d).select("univ_code", "row_id").join(v, "row_id", "left")
    w = W.partitionBy("univ_code")
    return p.select("univ_code", "row_id", "x", "y", (F.count("x").over(w) == F.count("*").over(w)).alias("aligned"), F.row_number().over(w.orderBy("row_id")).alias("place"))


def merged_scores(spark, d):
    """Latest scores of all walls in their merged order: place by wall and post id."""
    s = _latest(spark, d).select("univ_code", "post_id", "v", "a", "d")
    # Numbered inside each wall: no single task holds all rows.
    return s.withColumn("place", F.row_number().over(W.partitionBy("univ_code").orderBy("post_id"))).orderBy("univ_code", "place")


QUERIES = {
    f.__name__: f
    for f in (
        wall_alerts, wide_alerts, alert_posts, scoped_topics, topic_days, wall_week, wall_deltas, day_shares, wide_shares, danger_driver, danger_posts, feed_sorts, browser_sorts, first_sarcastic,
        temporal_signatures, topics_over_time, aligned_vectors, merged_scores,
    )
}

_ORD = ", ".join(f"{c} NULLS FIRST" for c in ORDER)
_SCORE = f"score AS (SELECT post_id, v, a, d, sarcasm, univ_code FROM vad_score QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY scored_at DESC NULLS LAST, {_ORD}) = 1)"
_WALL = f"""inst AS (SELECT row_id, CASE WHEN epoch_s BETWEEN {EARLIEST} AND {LATEST} THEN epoch_s END AS ts FROM ({instants.SQL["p6_found"]})),
post AS (SELECT post_id, row_id, text FROM golden_input QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY row_id DESC) = 1),
topic AS (SELECT * FROM topic_assignments QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY probability DESC NULLS LAST, run_id DESC, topic_id, univ_code) = 1),
lab AS (SELECT * FROM topic_labels QUALIFY row_number() OVER (PARTITION BY run_id, univ_code, topic_id ORDER BY record_id DESC) = 1), {_SCORE},
wall AS MATERIALIZED (SELECT topic.univ_code, topic.run_id, post.post_id, post.row_id, post.text, ts, topic.topic_id, CASE WHEN topic.topic_id = -1 THEN 'Noise' ELSE coalesce(lab.label, 'Topic ' || topic.topic_id) END AS label,
  v, a, d, coalesce(sarcasm, false) AS sarcasm
  FROM post JOIN topic USING (post_id) LEFT JOIN inst USING (row_id) LEFT JOIN score USING (post_id)
  LEFT JOIN lab ON lab.run_id = topic.run_id AND lab.univ_code = topic.univ_code AND lab.topic_id = topic.topic_id),
aged AS (SELECT *, max(ts) OVER (PARTITION BY univ_code) - ts AS age FROM wall WHERE ts IS NOT NULL), recent AS (SELECT * FROM aged WHERE age <= {DAY})"""


def _wide(sql: str) -> str:
    return sql.replace(f"age <= {DAY})", f"age <= {WIDE_DAYS * DAY})")


_ALERTS = f"""{_WALL}, sc AS (SELECT univ_code, count(*) AS n, avg(a) AS m, count(*) FILTER (v <= 3 AND a >= 7) AS crisis FROM recent WHERE a IS NOT NULL GROUP BY 1),
tp AS (SELECT univ_code, topic_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY univ_code) AS t, regexp_matches(min(label), '{CONCERN}', 'i') AS c FROM recent GROUP BY 1, 2),
sr AS (SELECT univ_code, topic_id, count(*) AS n, avg(sarcasm::INT) AS r, regexp_matches(min(label), '{CONCERN}', 'i') AS c FROM wall WHERE v IS NOT NULL GROUP BY 1, 2),
al AS (SELECT univ_code, 'intensity' AS kind, NULL::INT AS topic_id, 'warn' AS level, round(m, 4) AS figure, n, false AS concern FROM sc WHERE n >= 5 AND m > 6.2
UNION ALL SELECT univ_code, 'crisis', NULL, CASE WHEN crisis >= 5 THEN 'crit' ELSE 'warn-strong' END, crisis::DOUBLE, crisis, true FROM sc WHERE crisis >= 2
UNION ALL SELECT univ_code, 'concentration', topic_id, CASE WHEN c AND n / t >= 0.45 THEN 'crit' WHEN c THEN 'warn-strong' ELSE 'warn' END, round(n / t, 4), n, c FROM tp WHERE t >= 10 AND n / t >= 0.3 AND topic_id <> -1
UNION ALL SELECT univ_code, 'sarcasm', topic_id, CASE WHEN c AND r > 0.25 THEN 'crit' WHEN c THEN 'warn-strong' ELSE 'warn' END, round(r, 4), n, c FROM sr WHERE n >= 30 AND r > 0.15)"""


def _sorts(keys: dict[str, str], most: int, source: str) -> str:
    one = "SELECT univ_code, '{k}' AS sort_key, row_number() OVER (PARTITION BY univ_code ORDER BY {o}, row_id) AS place, post_id FROM {s} QUALIFY place <= {m}"
    return " UNION ALL ".join(f"({one.format(k=k, o=o, m=most, s=source)})" for k, o in keys.items())


SQL = {
    "wall_alerts": f"WITH {_ALERTS} SELECT *, CASE level WHEN 'crit' THEN 0 WHEN 'warn-strong' THEN 1 ELSE 2 END AS rank FROM al",
    "alert_posts": f"""WITH {_wide(_ALERTS)} SELECT w.univ_code, al.kind, al.topic_id AS alert_topic, w.post_id FROM wall w JOIN al USING (univ_code) LEFT JOIN (SELECT post_id, true AS near FROM recent) r USING (post_id)
        WHERE CASE WHEN kind = 'sarcasm' THEN w.topic_id = al.topic_id AND sarcasm WHEN near IS NULL THEN false WHEN kind = 'concentration' THEN w.topic_id = al.topic_id WHEN kind = 'crisis' THEN v <= 3 AND a >= 7 ELSE a IS NOT NULL END""",
    "scoped_topics": f"WITH {_WALL} SELECT univ_code, topic_id, count(*) AS size, count(v) AS scored, round(avg(v), 4) AS mean_v FROM aged WHERE age <= {SCOPE_DAYS * DAY} AND contains(lower(text), '{KEYWORD}') GROUP BY 1, 2",
    "topic_days": f"""WITH {_WALL}, p AS (SELECT *, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM aged),
        t AS (SELECT univ_code, day, topic_id FROM p GROUP BY univ_code, day, topic_id QUALIFY row_number() OVER (PARTITION BY univ_code, day ORDER BY count(*) DESC, topic_id) = 1)
        SELECT p.univ_code, p.day, count(*) AS n, round(avg(v), 4) AS mean_v, any_value(t.topic_id) AS top_topic FROM p JOIN t ON t.univ_code = p.univ_code AND t.day = p.day GROUP BY 1, 2""",
    "wall_week": f"""WITH {_WALL} SELECT univ_code, CASE WHEN age < {7 * DAY} THEN 'now' ELSE 'before' END AS week, count(*) AS n, count(*) FILTER (v <= 3) AS n_negative,
        round(avg(sarcasm::INT) FILTER (v IS NOT NULL), 4) AS sarcasm_rate FROM aged WHERE age < {14 * DAY} GROUP BY 1, 2""",
    "wall_deltas": f"""WITH {_WALL}, g AS (SELECT univ_code, count(v) FILTER (age < {7 * DAY}) AS n, count(v) FILTER (age >= {7 * DAY} AND age < {14 * DAY}) AS k, avg(v) FILTER (age < {7 * DAY}) AS v1,
        avg(v) FILTER (age >= {7 * DAY} AND age < {14 * DAY}) AS v0, avg(sarcasm::INT) FILTER (v IS NOT NULL AND age < {7 * DAY}) AS s1, avg(sarcasm::INT) FILTER (v IS NOT NULL AND age >= {7 * DAY} AND age < {14 * DAY}) AS s0 FROM aged GROUP BY 1)
        SELECT univ_code, round(CASE WHEN n >= 20 AND k >= 20 THEN v1 - v0 END, 4) AS v_delta, round(CASE WHEN n >= 20 AND k >= 20 THEN s1 - s0 END, 4) AS sarcasm_delta FROM g""",
    "day_shares": f"WITH {_WALL}, g AS (SELECT univ_code, topic_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY univ_code) AS t FROM recent GROUP BY 1, 2) SELECT univ_code, topic_id, n, round(n / t, 4) AS share FROM g WHERE t >= 10 AND n / t >= 0.3",
    "danger_driver": f"""WITH {_WALL}, g AS (SELECT univ_code, topic_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY univ_code), 4) AS share FROM wall WHERE a >= 5 AND d < 5 GROUP BY 1, 2)
        SELECT * FROM g WHERE topic_id <> -1 AND n >= 5 QUALIFY row_number() OVER (PARTITION BY univ_code ORDER BY n DESC, topic_id) = 1""",
    "danger_posts": f"WITH {_WALL} SELECT univ_code, count(*) FILTER (a >= 5 AND d < 5) AS danger, count(*) FILTER (v <= 3 AND a >= 7) AS crisis, count(*) FILTER (v <= 3) AS negative FROM wall GROUP BY 1",
    "feed_sorts": f"WITH {_WALL}, f AS (SELECT * FROM wall QUALIFY row_number() OVER (PARTITION BY univ_code ORDER BY row_id) <= 200) "
    + _sorts({"newest": "coalesce(ts, 0) DESC", "arousal": "coalesce(a, -1) DESC", "negative": "coalesce(v, 99)", "sarcasm": "sarcasm DESC, coalesce(ts, 0) DESC"}, 200, "f"),
    "browser_sorts": f"WITH {_WALL} "
    + _sorts({"ts": "coalesce(ts, 0) DESC", "text": "length(coalesce(text, '')) DESC", "topic": "topic_id DESC", "sarc": "sarcasm DESC", **{c: f"coalesce({c}, -99) DESC" for c in "vad"}}, 400, "wall"),
    "first_sarcastic": f"WITH {_WALL} SELECT univ_code, row_number() OVER (PARTITION BY univ_code ORDER BY row_id) AS place, post_id FROM wall WHERE sarcasm QUALIFY place <= 12",
    "temporal_signatures": f"""WITH {_WALL}, p AS (SELECT *, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') AS month FROM wall), ms AS (SELECT DISTINCT run_id, univ_code, month FROM p WHERE month IS NOT NULL),
        tp AS (SELECT DISTINCT run_id, univ_code, topic_id FROM p), n AS (SELECT run_id, univ_code, topic_id, month, count(*) AS n FROM p WHERE month IS NOT NULL GROUP BY ALL),
        x AS (SELECT tp.*, ms.month, coalesce(n.n, 0) AS c FROM tp JOIN ms USING (run_id, univ_code) LEFT JOIN n USING (run_id, univ_code, topic_id, month)),
        r AS (SELECT *, row_number() OVER (PARTITION BY run_id, univ_code, topic_id ORDER BY c) AS i, count(*) OVER (PARTITION BY run_id, univ_code, topic_id) AS k FROM x),
        g AS (SELECT run_id, univ_code, topic_id, sum(c)::BIGINT AS t, CASE WHEN sum(c) > 0 THEN 2 * sum(i * c) / (max(k) * sum(c)) - (max(k) + 1) / max(k) ELSE 0 END AS g FROM r GROUP BY 1, 2, 3),
        q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run_id, univ_code, topic_id ORDER BY n DESC, month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY run_id, univ_code, topic_id) AS t FROM n),
        z AS (SELECT run_id, univ_code, topic_id, string_agg(month, ',' ORDER BY month) AS cm FROM q WHERE b < 0.7 * t GROUP BY 1, 2, 3)
        SELECT tp.run_id, tp.univ_code, tp.topic_id, coalesce(g.t, 0) AS n_with_timestamp, round(coalesce(g.g, 0), 4) AS gini, round(coalesce(g.g, 0), 9) >= 0.6 AS is_event_driven, coalesce(cm, '') AS concentrated_months
        FROM tp LEFT JOIN g USING (run_id, univ_code, topic_id) LEFT JOIN z USING (run_id, univ_code, topic_id)""",
    "topics_over_time": f"""WITH {_WALL}, sp AS (SELECT univ_code, min(ts) AS lo, max(ts) AS hi, count(DISTINCT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m')) AS bins FROM aged GROUP BY 1),
        b AS (SELECT a.*, least(((ts - lo) * bins) // greatest(hi - lo, 1), bins - 1)::INT AS bin FROM aged a JOIN sp USING (univ_code)),
        tk AS (SELECT univ_code, topic_id, bin, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM b),
        tf AS (SELECT univ_code, topic_id, bin, term, count(*) AS tf FROM tk WHERE length(term) >= 3 AND term NOT IN ({", ".join(f"'{w}'" for w in STOP)}) GROUP BY ALL),
        cl AS (SELECT univ_code, topic_id, bin, sum(tf) AS s FROM tf GROUP BY ALL), av AS (SELECT avg(s) AS av FROM cl), ft AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1),
        w AS (SELECT univ_code, topic_id, bin, term, row_number() OVER (PARTITION BY univ_code, topic_id, bin ORDER BY round(tf / s * ln(1 + av / f), 9) DESC, term) AS k FROM tf JOIN cl USING (univ_code, topic_id, bin) JOIN ft USING (term) CROSS JOIN av QUALIFY k <= 5),
        ws AS (SELECT univ_code, topic_id, bin, string_agg(term, ',' ORDER BY k) AS words FROM w GROUP BY ALL), n AS (SELECT univ_code, topic_id, bin, count(*) AS frequency FROM b GROUP BY ALL)
        SELECT univ_code, topic_id, bin, frequency, coalesce(words, '') AS words FROM n LEFT JOIN ws USING (univ_code, topic_id, bin)""",
    "aligned_vectors": f"""WITH {_WALL}, p AS (SELECT univ_code, w.row_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM wall w LEFT JOIN embeddings e ON e.vec_id = w.row_id)
        SELECT *, count(x) OVER (PARTITION BY univ_code) = count(*) OVER (PARTITION BY univ_code) AS aligned, row_number() OVER (PARTITION BY univ_code ORDER BY row_id) AS place FROM p""",
    "merged_scores": f"WITH {_SCORE} SELECT univ_code, post_id, v, a, d, row_number() OVER (PARTITION BY univ_code ORDER BY post_id) AS place FROM score",
}
SQL["wide_alerts"] = _wide(SQL["wall_alerts"])
SQL["wide_shares"] = _wide(SQL["day_shares"])
