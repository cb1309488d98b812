"""Measures and relabelling of given clusters.

There is no built-in density clustering or manifold projection: k-means and principal components stand in for them where
labels have to be made (``sub_clusters``, ``reduce_vectors``); the measures take any labels. Outliers carry label -1.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.operators.dedup import keep_first


def class_terms(df: DataFrame, by: str, tokens: str, k: int) -> DataFrame:
    """The k terms of greatest class TF-IDF of every class: tf / class size * ln(1 + mean class size / term total)."""
    tf = df.select(by, F.explode(tokens).alias("term")).groupBy(by, "term").agg(F.count("*").alias("f"))
    size = tf.groupBy(by).agg(F.sum("f").alias("n"))
    mean = size.agg(F.avg("n").alias("a"))  # one row
    total = tf.groupBy("term").agg(F.sum("f").alias("ft"))
    s = tf.join(size, by).join(total, "term").join(F.broadcast(mean)).withColumn("score", F.col("f") / F.col("n") * F.log(1 + F.col("a") / F.col("ft")))
    order = W.partitionBy(by).orderBy(F.round("score", 9).desc(), "term")  # sums of floats differ in their last digits
    return s.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select(by, "term", "score")


def npmi(df: DataFrame, by: str, doc: str, tokens: str, top: int, least_df: int) -> DataFrame:
    """Mean normalised pointwise mutual information of the pairs of a class's most frequent terms, inside the class.

    Terms are counted once per document; pairs that never meet count -1, pairs in every document not at all. Pairs are
    made of at most ``top`` terms inside each document, so their number is bounded per document.
    """
    docs = df.select(by, doc, F.filter(F.array_distinct(tokens), lambda t: F.length(t) > 1).alias("ts"))
    size = docs.groupBy(by).agg(F.count("*").alias("n"))
    each = docs.select(by, doc, F.explode("ts").alias("term"))
    cf = each.groupBy(by, "term").agg(F.count("*").alias("k"))
    frequent = cf.groupBy("term").agg(F.sum("k").alias("df")).where(F.col("df") >= least_df).select("term")
    order = W.partitionBy(by).orderBy(F.desc("k"), "term")
    best = cf.join(frequent, "term").join(size.where("n >= 2").select(by), by).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).drop("r")
    lists = best.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("term", "k"))).alias("best"))
    pairs = F.flatten(F.transform("best", lambda x: F.transform(F.filter("best", lambda y: y["term"] > x["term"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    every = lists.select(by, F.explode(pairs).alias("p")).select(by, F.col("p.x.term").alias("x"), F.col("p.y.term").alias("y"), F.col("p.x.k").alias("kx"), F.col("p.y.k").alias("ky"))
    mine = docs.join(lists, by).select(by, F.array_sort(F.filter(F.transform("best", lambda b: b["term"]), lambda t: F.array_contains("ts", t))).alias("ts"))
    met = F.flatten(F.transform("ts", lambda x: F.transform(F.filter("ts", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    co = mine.select(by, F.explode(met).alias("p")).groupBy(by, "p.x", "p.y").agg(F.count("*").alias("c"))
    n = F.col("n")
    value = F.when(F.col("c").isNull(), -1.0).when(F.col("c") < n, F.log((F.col("c") / n) / ((F.col("kx") / n) * (F.col("ky") / n))) / -F.log(F.col("c") / n))
    return every.join(co, [by, "x", "y"], "left").join(size, by).withColumn("s", value).groupBy(by).agg(F.avg("s").alias("npmi")).where("npmi IS NOT NULL")


def silhouette(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """id and silhouette (squared Euclidean) of every vector with label other than -1; 0 in a cluster of one.

    The mean squared distance to a cluster follows from its sums: |x|² - 2 x·mean + mean|y|². So every vector meets each
    cluster once, and no pairs of vectors are made. The clusters' sums are one row per cluster and dimension.
    """
    x = df.where(F.col(label) != -1).select(F.col(id_col).alias("id"), F.col(label).alias("l"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    x = x.withColumn("q", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    sums = x.select("l", F.posexplode("x").alias("i", "v")).groupBy("l", "i").agg(F.sum("v").alias("s")).groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("s"))
    stats = x.groupBy("l").agg(F.count("*").alias("n"), F.sum("q").alias("sq")).join(sums, "l")
    # One row holding all clusters: as many entries as there are labels.
    every = stats.agg(F.collect_list(F.struct("l", "n", "sq", "s")).alias("cs"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    j = x.join(F.broadcast(every))
    far = F.transform("cs", lambda c: F.struct(c["l"].alias("l"), c["n"].alias("n"), (c["n"] * F.col("q") - 2 * dot(F.col("x"), c["s"]) + c["sq"]).alias("d")))
    j = j.select("id", "l", far.alias("far"))
    own = F.filter("far", lambda c: c["l"] == F.col("l"))[0]
    a = F.when(own["n"] > 1, own["d"] / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("far", lambda c: c["l"] != F.col("l")), lambda c: c["d"] / c["n"]))
    return j.select(F.col("id").alias(id_col), F.when(a.isNull() | b.isNull(), 0.0).otherwise((b - a) / F.greatest(a, b)).alias("silhouette"))


def centroids(df: DataFrame, id_col: str, vector: str, label: str, k: int) -> DataFrame:
    """The k vectors of every label nearest to the label's mean vector by cosine."""
    x = df.select(F.col(id_col), F.col(label), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    mean = x.select(label, F.posexplode("x").alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("m")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    j = x.join(mean, label).withColumn("cosine", dot("x", "c") / F.sqrt(dot("x", "x") * dot("c", "c")))
    order = W.partitionBy(label).orderBy(F.desc("cosine"), id_col)
    return j.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select(label, id_col, "cosine")


def dump_clusters(df: DataFrame, by: list[str], share: float) -> DataFrame:
    """Topics that hold more than ``share`` of their group's rows."""
    n = df.groupBy(*by, "topic_id").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(W.partitionBy(*by)))
    return n.where((F.col("topic_id") >= 0) & (F.col("n") / F.col("t") > share)).select(*by, "topic_id", "n", F.round(F.col("n") / F.col("t"), 4).alias("share"))


def soft_reassign(df: DataFrame, least: float = 0.5) -> DataFrame:
    """df with new_topic_id and moved: outliers whose probability reaches ``least`` go to their group's largest topic.

    Where the probabilities of all topics are there as an array, use ``best_topic``.
    """
    n = df.where("topic_id >= 0").groupBy("univ_code", "run_id", "topic_id").agg(F.count("*").alias("n"))
    big = keep_first(n, ["univ_code", "run_id"], [F.desc("n"), F.asc("topic_id")]).select("univ_code", "run_id", F.col("topic_id").alias("big"))
    moved = (F.col("topic_id") == -1) & F.coalesce(F.col("probability") >= least, F.lit(False)) & F.col("big").isNotNull()
    return df.join(big, ["univ_code", "run_id"], "left").withColumn("moved", moved).withColumn("new_topic_id", F.when(moved, F.col("big")).otherwise(F.col("topic_id"))).drop("big")


def best_topic(topic: Column, probabilities: Column, least: float = 0.5) -> Column:
    """The topic of greatest probability for an outlier, if that reaches ``least``; else the topic as it is."""
    p = F.array_max(probabilities)
    return F.when((topic == -1) & (p >= least), F.array_position(probabilities, p).cast("int") - 1).otherwise(topic)


def merge_sub_labels(df: DataFrame, topic: str, sub: str, parent: int) -> DataFrame:
    """df with ``new_topic``: rows of topic ``parent`` split by their sub-label. Sub-labels 0 and -1 stay with the parent,
    the others get new numbers after the greatest topic, in order. Without a real split all stays as it is."""
    inside = F.col(topic) == parent
    real = df.where(inside & (F.col(sub) != -1)).select(sub).distinct()
    facts = df.agg(F.max(topic).alias("top"), F.count_if(inside & (F.col(sub) == -1)).alias("n_out"))
    numbered = real.where(F.col(sub) > 0).withColumn("nth", F.row_number().over(W.orderBy(sub)))  # one row per sub-cluster of one topic
    n_real = real.agg(F.count("*").alias("n_real"))
    j = df.join(numbered, sub, "left").join(F.broadcast(facts.join(n_real)))
    split = inside & (F.col("n_real") > 0) & ~((F.col("n_real") == 1) & (F.col("n_out") == 0))
    return j.withColumn("new_topic", F.when(split & (F.col(sub) > 0), F.col("top") + F.col("nth")).otherwise(F.col(topic))).drop("nth", "top", "n_out", "n_real")


def reduce_vectors(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """df with ``reduced``: the first principal components (in place of a manifold projection)."""
    v = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=dims, inputCol="_v", outputCol="_r").fit(v).transform(v).withColumn("reduced", vector_to_array("_r")).drop("_v", "_r")


def sub_clusters(df: DataFrame, vector: str, k: int = 8, seed: int = 42, outlier_part: float = 0.0) -> DataFrame:
    """df with ``sub``: k-means clusters; all 0 where there are fewer than 2k rows. With ``outlier_part`` > 0 that part of
    the rows, the farthest from their centre, gets -1 (in place of a density clustering)."""
    if df.limit(2 * k).count() < 2 * k:
        return df.withColumn("sub", F.lit(0))
    v = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="sub").fit(v)
    out = model.transform(v)
    if outlier_part:
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
        dist = F.aggregate(F.zip_with(F.col(vector), centres[F.col("sub")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
        out = out.withColumn("_d", dist)
        cut = out.agg(F.percentile_approx("_d", 1 - outlier_part, 10_000).alias("_cut"))
        out = out.join(F.broadcast(cut)).withColumn("sub", F.when(F.col("_d") > F.col("_cut"), -1).otherwise(F.col("sub"))).drop("_d", "_cut")
    return out.drop("_v")


def merge_topics(terms: DataFrame, by: str, most: int) -> DataFrame:
    """``by`` and ``into``: topics merged by the cosine of their term weights until ``most`` are left, the closest first.

    terms: by, term, score; one row per topic and term. Topics are some hundred per run; their weights go to the driver.
    """
    rows = terms.select(by, "term", "score").toPandas()
    vec = rows.pivot_table(index=by, columns="term", values="score", fill_value=0.0)
    into = {t: t for t in vec.index}
    live = {t: vec.loc[t].to_numpy() for t in vec.index}
    while len(live) > max(1, most):
        names = sorted(live)
        m = [live[t] / max(1e-12, (live[t] ** 2).sum() ** 0.5) for t in names]
        best = max(((float(m[i] @ m[j]), -i, -j) for i in range(len(names)) for j in range(i)))
        a, b = names[-best[2]], names[-best[1]]
        live[a] = live[a] + live.pop(b)
        into = {t: a if g == b else g for t, g in into.items()}
    kind = terms.schema[by].dataType.simpleString()
    return terms.sparkSession.createDataFrame([(t, g) for t, g in into.items()], f"{by} {kind}, into {kind}")
