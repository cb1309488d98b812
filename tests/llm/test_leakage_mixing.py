"""Problems 8 and 9: leaks against brute force, mixtures against their promises."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import leakage as lk
from postloom.llm import mixing as mx


def brute_run(doc, item):
    d, w = lk.pieces(doc), lk.pieces(item)
    best = 0
    for i in range(len(d)):
        for j in range(len(w)):
            k = 0
            while i + k < len(d) and j + k < len(w) and d[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_run_and_subsequence():
    r = random.Random(1)
    for _ in range(60):
        a, b = (" ".join(r.choice("abcde") for _ in range(r.randrange(1, 30))) for _ in range(2))
        assert lk.longest_run(lk.pieces(a), lk.pieces(b), lk.word_numbers(b)) == brute_run(a, b)
    assert lk.common_subsequence(list("abcde"), list("axcye")) == 3 and lk.common_subsequence([], list("ab")) == 0
    assert lk.longest_run(lk.pieces("x mag-aral tayo"), lk.pieces("mag-aral tayo"), lk.word_numbers("mag-aral tayo")) == 2
    assert lk.longest_run(lk.pieces("aral tayo"), lk.pieces("mag-aral tayo"), lk.word_numbers("mag-aral tayo")) == 1


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in "bdgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "em", "is")]
    items = [(i, " ".join(r.choice(vocab) for _ in range(45)), "ans") for i in range(12)] + [(50, "short item", None), (51, None, None)]
    docs = []
    for d in range(80):
        w = [r.choice(vocab) for _ in range(r.randrange(20, 120))]
        if d % 4 == 0:
            src = items[d % 12][1].split()
            n = r.choice([8, 11, 12, 20, 45])
            at = r.randrange(0, len(src) - n + 1)
            piece = src[at : at + n]
            w[10:10] = [x.upper() if r.random() < 0.3 else x + "," for x in piece]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "!!!"), (903, ("  ​".join(items[0][1].split()[:14])).replace("a", "ａ")), (904, docs[0][1])]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, cosine double").repartition(3)
    it = spark.createDataFrame(items, "item_id long, item_text string, answer_text string")
    got = {(x.doc_id, x.item_id) for x in lk.find_leaks(df, it, rank=24).where("run >= 12").collect()}
    want = {(d, i) for d, t in docs for i, x, _ in items if t and x and brute_run(t, x) >= 12}
    assert got == want and len(want) > 8
    assert lk.find_leaks(df.limit(0), it, rank=8).count() == 0 and lk.find_leaks(df, it.limit(0), rank=8).count() == 0


def test_short_leaks_in_unrelated_documents(spark):
    """Twelve words in a row are found however little the rest of their passage is like the item."""
    r = random.Random(11)
    mine, other = ([f"{x}{a}{b}" for a in "bdgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "em", "is")] for x in ("q", ""))
    items = [(i, " ".join(r.choice(mine) for _ in range(45)), "ans") for i in range(12)]
    docs = []
    for d in range(120):
        w, src, at = [r.choice(other) for _ in range(200)], items[d % 12][1].split(), r.randrange(0, 33)
        n, to = (12, 11)[d % 4 == 3], r.randrange(0, 200)
        docs.append((d, " ".join(w[:to] + src[at : at + n] + w[to:])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, item_text string, answer_text string")
    # A cut that no passage reaches leaves the shared words alone to find them.
    for paraphrases, least in ((False, 0.3), (False, 1.1), (True, 1.1)):
        got = {(x.doc_id, x.item_id) for x in lk.find_leaks(df, it, least, 24, paraphrases).where("run >= 12").collect()}
        assert got == {(d, d % 12) for d in range(120) if d % 4 != 3}


def test_paraphrase_is_near(spark):
    item = "the council of the village ruled that every cart must carry the mark of the elder on its left wheel before the harvest"
    doc = "they say the council of that village had ruled every cart must carry the mark of an elder on its own left wheel before harvest"
    it = spark.createDataFrame([(1, item, "elder")], "item_id long, item_text string, answer_text string")
    x = lk.find_leaks(spark.createDataFrame([(1, doc), (2, "nothing alike here at all in these words")], "doc_id long, text string"), it, rank=4, min_cosine=0.2).where("doc_id = 1").first()
    assert x.run < 12 and x.lcs > 0.7 and x.has_answer


def test_found_retrieves_by_cosine(spark, sf, monkeypatch):
    """p8_found takes its candidates from the latent space, too, not from shared words alone."""
    from postloom.llm import q_leakage as q

    seen = []

    def kept(*a, **k):
        seen.append(lk.find_leaks(*a, **k))
        return seen[-1]

    monkeypatch.setattr(q, "find_leaks", kept)
    got = q.found(spark, sf)
    near = seen[0].where("run = 0 AND cosine >= 0.3").count()
    assert near > 0 and got.count() == seen[0].where("run >= 12").count()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_permutation(n):
    for key in (0, 1, 12345678901):
        p = mx.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(p.tolist()) == list(range(n))


@pytest.mark.parametrize("size", [1, 7, 32])
def test_draws_keep_the_plan(spark, size):
    plan = {"a": 1000, "b": 333, "c": 1}
    got = mx.draw_slots(spark, plan, 3, size).collect()
    by = {k: sorted(r.slot for r in got if r.source == k) for k in plan}
    assert by == {k: list(range(n)) for k, n in plan.items()}
    per = Counter(r.shard for r in got)
    assert set(list(per.values())[:-1]) <= {size, 1334 % size or size} and sum(per.values()) == 1334
    a = [Counter(r.shard for r in got if r.source == "a")[s] for s in range(len(per))]
    assert size == 1 or len(set(a)) > 1 and abs(sum(a) / 1334 - 1000 / 1334) < 1e-9


def test_draws_beyond_the_exact_range():
    c = np.array([3 * 10**10, 10**9, 5, 0])
    x = mx.halve(c, 10**10, [1, 2])
    assert x.sum() == 10**10 and (x >= 0).all() and (x <= c).all() and abs(x[0] / 10**10 - c[0] / c.sum()) < 1e-4


def test_totals():
    s = [{"source": "a", "tokens": 100, "target": 0.5, "cap": 1}, {"source": "b", "tokens": 1000, "target": 0.5, "cap": 2}, {"source": "c", "tokens": 50, "target": None, "cap": 3}]
    t = mx.plan_totals(s, None)
    assert t == {"a": 100, "b": 1000.0} and mx.plan_totals(s, 150) == {"a": 75.0, "b": 75.0} and mx.plan_totals(s, 10**9) == {"a": 100, "b": 2000} and mx.plan_totals([], 5) == {}


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["A"] * 6 + ["B", "C"]), " ".join(r.choice(["kape", "ulan", "exam", "dorm"]) for _ in range(r.randrange(1, 200)))) for i in range(400)]
    rows += [(1000, "B", None), (1001, "B", ""), (1002, None, "no source"), (1003, "D", "not wanted"), (1004, "A", "x " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))


def test_blocks_keep_every_token(spark, corpus):
    encode = mx._encoder(mx.default_tokenizer(spark))
    b = mx.numbered_blocks(corpus.repartition(5, "doc_id"), mx.default_tokenizer(spark), block=64).cache()
    want, tokens = Counter(), Counter()
    for r in corpus.where("text IS NOT NULL AND source IS NOT NULL").collect():
        for ids in encode([r.text]):
            want[r.source] += len(ids)
            tokens.update(ids)
    assert {r.source: r.n for r in b.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} == want
    no = b.groupBy("source").agg(F.count("*").alias("c"), F.count_distinct("block_no").alias("d"), F.min("block_no").alias("lo"), F.max("block_no").alias("hi"), F.max("n_tokens").alias("m"))
    assert all(r.c == r.d == r.hi + 1 and r.lo == 0 and r.m <= 64 for r in no.collect())
    hist = lambda df: {r.t: r.n for r in df.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    assert hist(b) == tokens


def test_mixture_keeps_shares_and_caps(spark, corpus):
    targets = spark.createDataFrame([("A", 0.4, 1), ("B", 0.3, 2), ("C", 0.2, 3), ("Z", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mx.mixture(corpus, targets, total=30_000, block=64, shard_blocks=32).cache()
    again = mx.mixture(corpus, targets, total=30_000, block=64, shard_blocks=32)
    key = ["shard", "source", "slot", "repeat_no", "block_no", "n_tokens"]
    assert sorted(map(tuple, m.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))
    cap = {"A": 1, "B": 2, "C": 3}
    used = m.groupBy("source", "block_no").agg(F.count("*").alias("n"))
    assert all(r.n <= cap[r.source] for r in used.collect())
    s = {r.source: r for r in mx.shares(m, corpus, targets).where("source IS NOT NULL").collect()}
    assert abs(sum(r.n_tokens for r in s.values()) - 30_000) < 1500 and s["Z"].n_tokens == 0 and s["D"].n_tokens == 0
    assert abs(s["A"].actual_share - 0.4 / 0.9) < 0.02 and abs(s["B"].actual_share - 0.3 / 0.9) < 0.02
    full = mx.mixture(corpus, targets, total=10**9, block=64, shard_blocks=32)
    n = {r.source: (r.n, r.d) for r in full.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("block_no").alias("d")).collect()}
    assert all(n[k][0] <= n[k][1] * cap[k] for k in n) and mx.mixture(corpus.limit(0), targets).count() == 0
