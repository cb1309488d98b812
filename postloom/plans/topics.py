"""Topics: assignments, labels, keywords, and the measures of clusters."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.functions import text as T
from postloom.io import table
from postloom.operators.clusters import centroids, class_terms, dump_clusters, npmi, silhouette, soft_reassign
from postloom.operators.dedup import keep_first
from postloom.operators.joins import invariants, with_label

TOPIC = ["run_id", "univ_code", "topic_id"]


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_assignments")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """One label per topic: that of the greatest record id."""
    return keep_first(table(spark, d, "topic_labels", *TOPIC, "label", "flags", "retries", "record_id"), TOPIC, [F.desc("record_id")])


def _posts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return keep_first(table(spark, d, "golden_input", "post_id", "row_id", *columns), ["post_id"], [F.desc("row_id")])


def labelled_posts(spark, d):
    """Assignments with their post's text length and topic label: inner on posts, left on labels."""
    j = _assigned(spark, d).select("post_id", *TOPIC).join(_posts(spark, d, "text"), "post_id")
    j = with_label(j, _labels(spark, d), TOPIC, "Unclassified", "Unclassified")
    return j.groupBy("univ_code", "topic_label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def page_posts(spark, d):
    """Assignments with label (Noise for outliers, else Topic n where none) and the latest score, all of it or none."""
    j = _assigned(spark, d).select("post_id", *TOPIC).join(_posts(spark, d), "post_id")
    j = with_label(j, _labels(spark, d), TOPIC, "Noise", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
    s = keep_first(table(spark, d, "vad_score"), ["post_id"], [F.desc("scored_at"), F.asc("researcher_id"), F.asc("model_version"), F.asc("v"), F.asc("a"), F.asc("d")])
    full = F.col("v").isNotNull() & F.col("a").isNotNull() & F.col("d").isNotNull()
    s = s.select("post_id", *[F.when(full, F.col(c)).alias(c) for c in "vad"])
    j = j.join(s, "post_id", "left")
    return j.groupBy("univ_code", "topic_id", "topic_label").agg(F.count("*").alias("n"), F.count("v").alias("scored"), F.round(F.avg("v"), 2).alias("mean_v"))


def coverage(spark, d):
    """Posts, scored posts and their part per university."""
    s = table(spark, d, "vad_score", "post_id").distinct().withColumn("hit", F.lit(1))
    j = _assigned(spark, d).select("univ_code", "post_id").distinct().join(s, "post_id", "left")
    return j.groupBy("univ_code").agg(F.count("*").alias("posts"), F.count("hit").alias("scored"), F.round(F.count("hit") / F.count("*"), 4).alias("coverage"))


def assignment_checks(spark, d):
    return invariants(table(spark, d, "golden_input", "post_id"), _assigned(spark, d), table(spark, d, "topic_labels", *TOPIC), "post_id", TOPIC)


def topic_sizes(spark, d):
    out = F.count_if(F.col("topic_id") == -1)
    return _assigned(spark, d).groupBy("univ_code", "run_id").agg(
        F.count_distinct(F.when(F.col("topic_id") >= 0, F.col("topic_id"))).alias("n_topics"), F.count_distinct("topic_id").alias("n_groups"),
        out.alias("n_outliers"), F.round(out / F.count("*"), 4).alias("outlier_rate"),
    )


def top_topics(spark, d):
    """The three largest groups of every run, outliers included."""
    n = _assigned(spark, d).groupBy("univ_code", "run_id", "topic_id").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("univ_code", "run_id").orderBy(F.desc("n"), "topic_id"))).where("k <= 3")


def topic_keywords(spark, d):
    """The keywords of every topic in order, as one text."""
    k = table(spark, d, "topic_keywords").where("word IS NOT NULL AND kw_rank <= 10")
    words = F.array_sort(F.collect_list(F.struct("kw_rank", F.lower(F.trim("word")).alias("w"))))
    return k.groupBy("run_id", "topic_id").agg(F.array_join(F.transform(words, lambda x: x["w"]), ",").alias("keywords"))


def keyword_join(spark, d):
    """Topics of the assignments with the number of their keywords, matched on the number as text."""
    k = table(spark, d, "topic_keywords", "run_id", "topic_id").groupBy("run_id", F.col("topic_id").alias("t")).agg(F.count("*").alias("n_keywords"))
    a = _assigned(spark, d).select("run_id", "topic_id").distinct()
    j = a.join(k, (a.run_id == k.run_id) & (a.topic_id.cast("string") == k.t), "left")
    return j.select(a.run_id, a.topic_id, F.coalesce("n_keywords", F.lit(0)).alias("n_keywords"))


def label_quality(spark, d):
    l = _labels(spark, d)  # noqa: E741
    rate = lambda f: F.round(F.avg(F.coalesce(F.array_contains("flags", f), F.lit(False)).cast("int")), 4).alias(f"{f}_rate")
    lazy = F.count_if(T.is_lazy(F.col("label"))).alias("n_lazy_text")
    return l.groupBy("univ_code").agg(F.count("*").alias("n"), rate("lazy"), rate("api_fail"), rate("event_driven"), lazy, F.sum(F.coalesce("retries", F.lit(0))).alias("retries"))


def duplicate_labels(spark, d):
    """Labels that stand for topics of more than one university."""
    l = _labels(spark, d).where("label IS NOT NULL")  # noqa: E741
    return l.groupBy("label").agg(F.count_distinct("univ_code").alias("n_univ"), F.count("*").alias("n_topics")).where("n_univ > 1")


def distinct_labels(spark, d):
    """Labels that repeat within a university get their topic's first keyword in brackets."""
    l = _labels(spark, d).select(*TOPIC, "label")  # noqa: E741
    first = table(spark, d, "topic_keywords").where("kw_rank = 1").select("run_id", F.col("topic_id").cast("int").alias("topic_id"), F.lower(F.trim("word")).alias("w"))
    n = F.count("*").over(W.partitionBy("univ_code", "label"))
    new = F.when((F.col("n") > 1) & (F.col("label") != "Unlabeled") & F.col("w").isNotNull(), F.concat("label", F.lit(" ("), "w", F.lit(")"))).otherwise(F.col("label"))
    return l.withColumn("n", n).join(first, ["run_id", "topic_id"], "left").select(*TOPIC, new.alias("label"))


def dumps(spark, d):
    return dump_clusters(_assigned(spark, d), ["univ_code", "run_id"], 0.2)


def reassigned(spark, d):
    """Outliers whose best probability reaches one half move to their group's largest topic."""
    return soft_reassign(_assigned(spark, d)).groupBy("univ_code", "new_topic_id").agg(F.count("*").alias("n"), F.count_if("moved").alias("n_moved"))


def _classed(spark, d):
    a = keep_first(_assigned(spark, d).where("topic_id >= 0"), ["post_id"], [F.asc("run_id"), F.asc("topic_id"), F.asc("probability")])
    p = _posts(spark, d, "text").where("text IS NOT NULL")
    return a.join(p, "post_id").select(F.concat_ws("/", "univ_code", F.col("topic_id").cast("string")).alias("class"), "row_id", T.words(F.col("text"), "[a-z]+").alias("ts"))


def class_keywords(spark, d):
    """The ten terms of greatest class TF-IDF of every topic."""
    return class_terms(_classed(spark, d), "class", "ts", 10).withColumn("score", F.round("score", 6))


def class_npmi(spark, d):
    return npmi(_classed(spark, d), "class", "row_id", "ts", top=10, least_df=5).withColumn("npmi", F.round("npmi", 4))


def vector_silhouette(spark, d):
    return silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label").agg(F.round(F.avg("silhouette"), 4).alias("silhouette"), F.count("*").alias("n"))


def nearest_to_centre(spark, d):
    """The five vectors of every label that are nearest to its centre by cosine."""
    return centroids(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 5).withColumn("cosine", F.round("cosine", 4))


QUERIES = {
    f.__name__: f
    for f in (
        labelled_posts, page_posts, coverage, assignment_checks, topic_sizes, top_topics, topic_keywords, keyword_join, label_quality, duplicate_labels, distinct_labels,
        dumps, reassigned, class_keywords, class_npmi, vector_silhouette, nearest_to_centre,
    )
}

_LAB = "lab AS (SELECT * FROM topic_labels QUALIFY row_number() OVER (PARTITION BY run_id, univ_code, topic_id ORDER BY record_id DESC) = 1)"
_POST = "post AS (SELECT * FROM golden_input QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY row_id DESC) = 1)"
_CLASS = f"""WITH {_POST}, a AS (SELECT * FROM topic_assignments WHERE topic_id >= 0 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY run_id, topic_id, probability NULLS FIRST) = 1),
c AS (SELECT univ_code || '/' || topic_id AS class, row_id, regexp_extract_all(lower(text), '[a-z]+') AS ts FROM a JOIN post USING (post_id) WHERE text IS NOT NULL),
w AS (SELECT class, row_id, unnest(ts) AS term FROM c)"""
SQL = {
    "labelled_posts": f"""WITH {_LAB}, {_POST} SELECT a.univ_code, CASE WHEN a.topic_id = -1 THEN 'Unclassified' ELSE coalesce(lab.label, 'Unclassified') END AS topic_label, count(*) AS n, sum(length(post.text))::BIGINT AS chars
        FROM topic_assignments a JOIN post USING (post_id) LEFT JOIN lab ON lab.run_id = a.run_id AND lab.univ_code = a.univ_code AND lab.topic_id = a.topic_id GROUP BY ALL""",
    "page_posts": f"""WITH {_LAB}, {_POST}, s AS (SELECT * FROM vad_score QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY scored_at DESC NULLS LAST, researcher_id NULLS FIRST, model_version NULLS FIRST, v NULLS FIRST, a NULLS FIRST, d NULLS FIRST) = 1),
        j AS (SELECT a.univ_code, a.topic_id, CASE WHEN a.topic_id = -1 THEN 'Noise' ELSE coalesce(lab.label, 'Topic ' || a.topic_id) END AS topic_label,
          CASE WHEN s.v IS NOT NULL AND s.a IS NOT NULL AND s.d IS NOT NULL THEN s.v END AS v FROM topic_assignments a JOIN post USING (post_id)
          LEFT JOIN lab ON lab.run_id = a.run_id AND lab.univ_code = a.univ_code AND lab.topic_id = a.topic_id LEFT JOIN s ON s.post_id = a.post_id)
        SELECT univ_code, topic_id, topic_label, count(*) AS n, count(v) AS scored, round(avg(v), 2) AS mean_v FROM j GROUP BY ALL""",
    "coverage": """SELECT univ_code, count(*) AS posts, count(s.post_id) AS scored, round(count(s.post_id) / count(*), 4) AS coverage FROM (SELECT DISTINCT univ_code, post_id FROM topic_assignments) a
        LEFT JOIN (SELECT DISTINCT post_id FROM vad_score) s USING (post_id) GROUP BY 1""",
    "assignment_checks": """SELECT 'extra' AS problem, count(DISTINCT post_id) AS n FROM topic_assignments WHERE post_id NOT IN (SELECT post_id FROM golden_input WHERE post_id IS NOT NULL)
        UNION ALL SELECT 'missing', count(DISTINCT post_id) FROM golden_input WHERE post_id NOT IN (SELECT post_id FROM topic_assignments WHERE post_id IS NOT NULL)
        UNION ALL SELECT 'repeated', count(*) FROM (SELECT post_id FROM topic_assignments GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT DISTINCT run_id, univ_code, topic_id FROM topic_assignments WHERE topic_id <> -1 EXCEPT SELECT run_id, univ_code, topic_id FROM topic_labels)""",
    "topic_sizes": """SELECT univ_code, run_id, count(DISTINCT topic_id) FILTER (topic_id >= 0) AS n_topics, count(DISTINCT topic_id) AS n_groups, count(*) FILTER (topic_id = -1) AS n_outliers,
        round(count(*) FILTER (topic_id = -1) / count(*), 4) AS outlier_rate FROM topic_assignments GROUP BY ALL""",
    "top_topics": "SELECT univ_code, run_id, topic_id, n, row_number() OVER (PARTITION BY univ_code, run_id ORDER BY n DESC, topic_id) AS k FROM (SELECT univ_code, run_id, topic_id, count(*) AS n FROM topic_assignments GROUP BY ALL) QUALIFY k <= 3",
    "topic_keywords": "SELECT run_id, topic_id, string_agg(lower(trim(word, ' ')), ',' ORDER BY kw_rank, lower(trim(word, ' '))) AS keywords FROM topic_keywords WHERE word IS NOT NULL AND kw_rank <= 10 GROUP BY ALL",
    "keyword_join": """SELECT a.run_id, a.topic_id, coalesce(k.n, 0) AS n_keywords FROM (SELECT DISTINCT run_id, topic_id FROM topic_assignments) a
        LEFT JOIN (SELECT run_id, topic_id, count(*) AS n FROM topic_keywords GROUP BY ALL) k ON k.run_id = a.run_id AND k.topic_id = a.topic_id::VARCHAR""",
    "label_quality": f"""WITH {_LAB} SELECT univ_code, count(*) AS n, round(avg(coalesce(list_contains(flags, 'lazy'), false)::INT), 4) AS lazy_rate, round(avg(coalesce(list_contains(flags, 'api_fail'), false)::INT), 4) AS api_fail_rate,
        round(avg(coalesce(list_contains(flags, 'event_driven'), false)::INT), 4) AS event_driven_rate,
        count(*) FILTER (trim(coalesce(label, ''), ' ') = '' OR regexp_matches(trim(label, ' '), '^(general(\\s+\\w+)?|various(\\s+\\w+)?|misc(ellaneous)?(\\s+\\w+)?|other(\\s+\\w+)?|topic\\s*\\d+|noise|miscellaneous topics?|assorted)\\s*$', 'i')
          OR lower(trim(label, ' ')) IN ({", ".join(f"'{p}'" for p in T.LAZY_PHRASES)})) AS n_lazy_text, sum(coalesce(retries, 0))::BIGINT AS retries FROM lab GROUP BY 1""",
    "duplicate_labels": f"WITH {_LAB} SELECT label, count(DISTINCT univ_code) AS n_univ, count(*) AS n_topics FROM lab WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT univ_code) > 1",
    "distinct_labels": f"""WITH {_LAB}, n AS (SELECT run_id, univ_code, topic_id, label, count(*) OVER (PARTITION BY univ_code, label) AS n FROM lab)
        SELECT n.run_id, n.univ_code, n.topic_id, CASE WHEN n > 1 AND label <> 'Unlabeled' AND w IS NOT NULL THEN label || ' (' || w || ')' ELSE label END AS label
        FROM n LEFT JOIN (SELECT run_id, topic_id::INT AS topic_id, lower(trim(word, ' ')) AS w FROM topic_keywords WHERE kw_rank = 1) k ON k.run_id = n.run_id AND k.topic_id = n.topic_id""",
    "dumps": """SELECT univ_code, run_id, topic_id, n, round(n / total, 4) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY univ_code, run_id) AS total FROM (SELECT univ_code, run_id, topic_id, count(*) AS n FROM topic_assignments GROUP BY ALL))
        WHERE topic_id >= 0 AND n / total > 0.2""",
    "reassigned": """WITH g AS (SELECT univ_code, run_id, topic_id, count(*) AS k FROM topic_assignments WHERE topic_id >= 0 GROUP BY ALL),
        n AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY univ_code, run_id ORDER BY k DESC, topic_id) = 1),
        j AS (SELECT a.univ_code, CASE WHEN a.topic_id = -1 AND probability >= 0.5 AND n.topic_id IS NOT NULL THEN n.topic_id ELSE a.topic_id END AS new_topic_id, a.topic_id = -1 AND coalesce(probability >= 0.5, false) AND n.topic_id IS NOT NULL AS moved
          FROM topic_assignments a LEFT JOIN n ON n.univ_code = a.univ_code AND n.run_id = a.run_id)
        SELECT univ_code, new_topic_id, count(*) AS n, count(*) FILTER (moved) AS n_moved FROM j GROUP BY ALL""",
    "class_keywords": _CLASS + """, tf AS (SELECT class, term, count(*) AS f FROM w GROUP BY ALL), size AS (SELECT class, sum(f) AS n FROM tf GROUP BY 1), tot AS (SELECT term, sum(f) AS ft FROM tf GROUP BY 1), av AS (SELECT avg(n) AS a FROM size),
        s AS (SELECT class, term, round(f / n * ln(1 + a / ft), 6) AS score, f / n * ln(1 + a / ft) AS raw FROM tf JOIN size USING (class) JOIN tot USING (term) CROSS JOIN av)
        SELECT class, term, score FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY raw DESC, term) <= 10""",
    "class_npmi": _CLASS + """, u AS (SELECT DISTINCT class, row_id, term FROM w WHERE length(term) > 1), df AS (SELECT term, count(*) AS n FROM u GROUP BY 1), sz AS (SELECT class, count(*) AS n FROM c GROUP BY 1),
        cf AS (SELECT class, term, count(*) AS k FROM u GROUP BY ALL),
        top AS (SELECT cf.* FROM cf JOIN df USING (term) JOIN sz USING (class) WHERE df.n >= 5 AND sz.n >= 2 QUALIFY row_number() OVER (PARTITION BY class ORDER BY k DESC, term) <= 10),
        t AS (SELECT class, row_id, term, k FROM u JOIN top USING (class, term)),
        pair AS (SELECT a.class, a.term AS x, b.term AS y, a.k AS kx, b.k AS ky FROM top a JOIN top b ON a.class = b.class AND a.term < b.term),
        co AS (SELECT a.class, a.term AS x, b.term AS y, count(*) AS n FROM t a JOIN t b ON a.class = b.class AND a.row_id = b.row_id AND a.term < b.term GROUP BY ALL),
        v AS (SELECT pair.class, CASE WHEN co.n IS NULL THEN -1.0 WHEN co.n = sz.n THEN NULL ELSE ln((co.n / sz.n) / ((kx / sz.n) * (ky / sz.n))) / -ln(co.n / sz.n) END AS s FROM pair LEFT JOIN co USING (class, x, y) JOIN sz USING (class))
        SELECT class, round(avg(s), 4) AS npmi FROM v GROUP BY 1 HAVING count(s) > 0""",
    "vector_silhouette": """WITH e AS (SELECT vec_id, label, embedding FROM embeddings), d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS s, count(*) AS n
          FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
        m AS (SELECT vec_id, max(CASE WHEN la = lb THEN s / n END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY 1)
        SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette, count(*) AS n FROM m""",
    "nearest_to_centre": """WITH x AS (SELECT label, unnest(generate_series(1, 64)) AS i, embedding, vec_id FROM embeddings), c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM x GROUP BY ALL),
        s AS (SELECT vec_id, x.label, sum(embedding[i]::DOUBLE * m) / sqrt(sum(embedding[i]::DOUBLE ** 2) * sum(m * m)) AS cosine FROM x JOIN c USING (label, i) GROUP BY ALL)
        SELECT label, vec_id, round(cosine, 4) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) <= 5""",
}
