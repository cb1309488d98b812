"""Duplicates, joins, windows, clusters and scores: brute force on small fixtures, ties, nulls, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import clusters, dedup, joins, scores, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_keep_first_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w")], "id long, k string, _rank string")
    assert sorted(r.id for r in dedup.keep_first(df, ["k"], [F.col("id")]).collect()) == [1, 3]
    rej = dedup.rejected(df, ["k"], [F.col("id")], "dup", "_rank").collect()
    assert sorted(r.id for r in rej) == [2, 4] and {r.reason for r in rej} == {"dup"}
    assert dedup.keep_first(df.limit(0), ["k"], [F.col("id")]).count() == 0


def brute_classes(texts, n=5, least=0.8):
    import re

    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts}
    head = {}
    for i, w in sorted(toks.items()):
        head.setdefault(tuple(w), i)
    sets = {h: {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w, h in head.items() if w}
    root = {h: h for h in head.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    hs = sorted(sets)
    for a in hs:
        for b in hs:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                links[a] += 1
                links[b] += 1
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: (head[tuple(w)], find(head[tuple(w)]), links[head[tuple(w)]]) for i, w in toks.items()}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(60)}" for _ in range(40)] for _ in range(6)]
    texts = []
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(r.randrange(3)):
            w[r.randrange(40)] = f"w{r.randrange(60)}"
        texts.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(60)]
    texts += [(100 + k, " ".join(chain[2 * k : 2 * k + 40])) for k in range(10)]  # a~b~c, a not like c
    texts += [(200, None), (201, ""), (202, "  "), (203, "one two"), (204, "One, two!"), (205, "x " * 5000)]
    got = {x.doc_id: (x.copy_of, x.class_id, x.n_links) for x in dedup.near_duplicate_classes(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_in_passes(spark, monkeypatch):
    """Sets that meet on rare items in several passes give the pairs of one, and those that share but a sentence are not written whole."""
    r = random.Random(7)
    shared = [f"s{k}" for k in range(30)]
    texts = [(i, " ".join([*shared, *(f"w{i}x{k}" for k in range(r.randrange(20, 60)))])) for i in range(300)]
    texts += [(1000 + i, t + " more") for i, t in texts[:20]]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_classes(texts)
    written, materialise = {}, dedup.materialise
    monkeypatch.setattr(dedup, "materialise", lambda d, label: written.setdefault((label, len(written)), materialise(d, label)))
    for items in (10**9, 1):
        written.clear()
        monkeypatch.setattr(dedup, "_PASS_ITEMS", items)
        assert {x.doc_id: (x.copy_of, x.class_id, x.n_links) for x in dedup.near_duplicate_classes(df, "doc_id", "text").collect()} == want
        assert sum(label == "candidates" for label, _ in written) == (2 if items > 1 else 5)
        assert [d.count() for (label, _), d in written.items() if label == "sets"] == [40]


def test_written_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from postloom.session import materialise

    files = lambda: {str(f) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(str(d)).rglob("shuffle_*.data")}
    before = files()
    df = materialise(spark.range(100_000).selectExpr("id % 977 AS k").groupBy("k").count(), "sums")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and df.count() == 977


def test_connected_long_chain_and_empty(spark):
    chain = spark.range(0, 200).selectExpr("id AS a", "id + 1 AS b")
    assert {x.root for x in dedup.connected(chain).collect()} == {0}
    assert dedup.connected(chain.limit(0)).count() == 0


def test_labels_and_reconcile(spark):
    a = spark.createDataFrame([("p1", 1), ("p2", -1), ("p3", 9), ("p4", None)], "post_id string, topic_id int")
    lab = spark.createDataFrame([(1, "One"), (-1, "Never")], "topic_id int, label string")
    assert {r.post_id: r.topic_label for r in joins.with_label(a, lab, ["topic_id"], "Out", "None").collect()} == {"p1": "One", "p2": "Out", "p3": "None", "p4": "None"}
    exp = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = spark.createDataFrame([("a", 1), ("a", 2), ("d", 3), ("b", 4)], "id string, v int")
    r = {x.id: (x.status, x.n_got, x.v) for x in joins.reconcile(exp, got, "id", [F.desc("v")]).collect()}
    assert r == {"a": ("matched", 2, 2), "b": ("matched", 1, 4), "c": ("missing", 0, None), "d": ("extra", 1, 3)}


def test_windows(spark):
    d = spark.sql("SELECT 'g' g, date'2024-01-01' day, 10L n, 1.0D mean UNION ALL SELECT 'g', date'2024-01-04', 30L, 3.0D")
    dense = windows.every_day(d, ["g"])
    r = {str(x.day): x.rolling for x in windows.rolling_mean(dense, ["g"], 3).collect()}
    assert r == {"2024-01-01": 1.0, "2024-01-02": 1.0, "2024-01-03": 1.0, "2024-01-04": 3.0}
    q = windows.quiet_spells(dense, ["g"], 2).collect()
    assert [(str(x.first_day), x.n_days) for x in q] == [("2024-01-02", 2)]
    c = spark.createDataFrame([("g", "a", 5), ("g", "b", 5), ("g", "c", 1), ("h", "a", 9)], "g string, m string, n int")
    assert sorted((x.g, x.m) for x in windows.concentrated(c, ["g"], "m", "n").collect()) == [("g", "a"), ("g", "b"), ("h", "a")]
    e = spark.createDataFrame([(100 * 86400 - 1, 2.0), (90 * 86400, 1.0)], "t long, v double")
    x = windows.window_delta(e, "t", F.col("v"), [], 7, 1).first()
    assert (x.n_now, x.n_before, x.delta) == (1, 1, 1.0) and windows.window_delta(e, "t", F.col("v"), [], 7, 2).first().delta is None


@pytest.mark.parametrize(
    ("sub", "want"),
    [
        ([0, 0, 1, 1, 2, 2], [5, 5, 10, 10, 11, 11]),
        ([0, -1, 1, 1, -1, 0], [5, 5, 10, 10, 5, 5]),
        ([-1, -1, -1], [5, 5, 5]),
        ([0, 0, 0], [5, 5, 5]),
    ],
)
def test_sub_labels(spark, sub, want):
    data = [(i, 5, s) for i, s in enumerate(sub)] + [(100, 9, 0)]
    got = {r.i: r.new_topic for r in clusters.merge_sub_labels(spark.createDataFrame(data, "i int, t int, s int"), "t", "s", 5).collect()}
    assert [got[i] for i in range(len(sub))] == want and got[100] == 9


def test_cluster_tools(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01, 0.0], i % 2) for i in range(40)], "id long, x array<double>, l int")
    assert clusters.silhouette(v, "id", "x", "l").agg(F.avg("silhouette")).first()[0] > 0.99
    assert clusters.silhouette(v.where("id = 0"), "id", "x", "l").first().silhouette == 0.0
    s = clusters.sub_clusters(v, "x", 2, outlier_part=0.1)
    assert {r.sub for r in s.collect()} >= {0, 1} and {r.sub for r in clusters.sub_clusters(v.limit(3), "x", 2).collect()} == {0}
    assert len(clusters.reduce_vectors(v, "x", 1).first().reduced) == 1
    t = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.9), (2, "b", 0.1), (3, "c", 1.0)], "t int, term string, score double")
    assert {r.t: r.into for r in clusters.merge_topics(t, "t", 2).collect()} == {1: 1, 2: 1, 3: 3}
    p = spark.createDataFrame([(-1, [0.1, 0.7]), (-1, [0.4, 0.3]), (4, [0.9, 0.0])], "t int, p array<double>")
    assert [r[0] for r in p.select(clusters.best_topic(F.col("t"), F.col("p"))).collect()] == [1, -1, 4]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"id": "a", "V": 3, "A": "5", "D": 7.0, "sarcasm": true}]', [("a", 3, 5, 7, True)]),
        ('{"post_id": "b", "V": "4", "A": 5, "D": 6}', [("b", 4, 5, 6, False)]),
        ('Sure! [{"id": "c", "V": 3.7, "A": 5, "D": 6, "sarcasm": "yes"}] ok', [("c", 3, 5, 6, True)]),
        ('[{"id": "d", "V": true, "A": 5, "D": 6}]', None),
        ('[{"id": "e", "V": 1, "A": 5}]', None),
        ('[{"V": 1, "A": 5, "D": 6}]', None),
        ("no scores", None), ("", None), (None, None), ("[]", []),
    ],
)
def test_answers(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(scores.parse_answer(F.col("t")).alias("r")).first().r
    assert (got if got is None else [tuple(x) for x in got]) == want


@pytest.mark.parametrize("bins", [1, 2, 3, 4, 5])
def test_largest_first(bins):
    jobs = [(f"j{i}", float(s)) for i, s in enumerate([9, 8, 7, 6, 5, 4, 3, 2, 1, 1])]
    out = scores.largest_first(jobs, bins)
    load = [sum(s for n, s in jobs for m, b, _ in out if m == n and b == k) for k in range(bins)]
    assert len(out) == 10 and sum(load) == 46 and max(load) <= 46 / bins + 9


def test_agreement(spark):
    df = spark.createDataFrame([(1, 2, True, True), (5, 5, False, False), (9, 1, True, False), (4, 3, False, False)], "a int, b int, p boolean, q boolean")
    r = scores.agreement(df, {"v": ("a", "b")}, ("p", "q")).first()
    assert r.v_within_1 == 0.75 and r.kappa == pytest.approx(0.5) and scores.agreement(df.limit(0), {"v": ("a", "b")}, ("p", "q")).first().n == 0


def test_near_duplicates_write_no_texts_or_sets_of_all_rows(spark):
    from tests.test_cleaning import scratch_bytes

    from postloom.plans.posts import near_duplicates

    assert 0 < scratch_bytes(spark, near_duplicates, "/root/testdata/sf0.01") < 4 * 117_824  # four times documents.parquet
