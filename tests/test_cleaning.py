"""The rule table, the whole cleaning and greedy near-duplicate removal, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.operators.anonymise import School, anonymised, load_schools, masked, rule_table, unmasked
from postloom.operators.dedup import near_dedupe
from postloom.plans import cleaning as cl

SCHOOLS = [
    School("UX", "North", r"#UXWall\d+", ["Xana University", "Xana"], [("Old Gate", True), ("Tree Lane", False)], ["go ux", "rah"], case_sensitive=True),
    School("YY", "South", r"#YYWall\d+", ["Yana de Xana"], [], ["hoy"], skip_acronym=True),
]


def brute(text, rules):
    labels, regions = [], set()
    for r in rules:
        before = r"(?<![#\w])" if r.kind == "acronym" else r"(?<!\w)"
        p = re.compile(r.what if r.kind == "tag" else before + re.escape(r.what) + r"(?!\w)", re.IGNORECASE if r.any_case else 0)
        if p.search(text):
            labels.append(r.label)
            regions |= {r.region} - {None}
            text = p.sub(r.to, text)
    return text, labels, sorted(regions)


def test_rules_against_brute_force(spark):
    rules = rule_table(SCHOOLS, ["rah"])
    kinds = [r.label.partition(":")[0] for r in rules]
    assert kinds == ["tag", "tag", "name", "name", "name", "place", "place", "cheer", "cheer", "ambiguous", "acronym"]
    assert [r.what for r in rules if r.label.startswith("name")] == ["Xana University", "Yana de Xana", "Xana"]
    r = random.Random(3)
    parts = ["#UXWall12", "xana university", "Xana", "Yana de Xana", "old gate", "Tree Lane", "go ux", "RAH", "hoy", "UX", "ux", "#UX", "UXB", "ñXana", "kape", "\n", "."]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(300)] + ["", "plain"]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "i int, t string")
    got = {x.i: x.a for x in df.select("i", anonymised(F.col("t"), rules).alias("a")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].text, got[i].labels, got[i].regions) == brute(t, rules), t
    assert got[999].text is None and got[999].labels == [] and df.select(anonymised(F.col("t"), []).alias("a")).where("a.text = t").count() == len(texts)


def test_schools_from_yaml():
    schools, unsure = load_schools(cl.SCHOOLS)
    assert len(schools) == 7 and unsure and schools[2].markers == [("computer lab", False)] and load_schools("") == ([], [])


def test_masks(spark):
    t = "[NAME] met [A_1] at [photo] [NAME]"
    df = spark.createDataFrame([(t,), ("none",), ("",), (None,)], "t string")
    hidden, tags = masked(F.col("t"))
    rows = df.withColumn("h", hidden).withColumn("g", tags).select("t", "h", "g", unmasked(F.col("h"), F.col("g")).alias("b")).collect()
    assert all(r.b == r.t for r in rows) and rows[0].g == ["[NAME]", "[A_1]", "[NAME]"] and "[NAME]" not in rows[0].h and "[photo]" in rows[0].h


@pytest.mark.parametrize(("text", "want"), [("1-3,7,9", {1, 2, 3, 7, 9}), ("", set()), (" 4 , ,6-5", {4}), ("1-10", set(range(1, 11)))])
def test_phases(text, want):
    assert cl.phases(text) == want


def test_clean_whole_table(spark, sf):
    n = spark.read.parquet(f"{sf}/golden_input.parquet").count()
    assert cl.clean_posts(spark, sf).count() + cl.clean_rejects(spark, sf).count() == n
    kept = cl.clean_fully(spark, sf)
    assert kept.columns == cl.FINAL and 0 < kept.count() <= cl.clean_posts(spark, sf).count()
    assert cl.clean(spark, sf, "7").where("reason IS NOT NULL").count() == 0


def shingle_set(t, n=3):
    w = re.findall("[A-Za-z0-9]+", (t or "").lower())
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_dedupe_is_greedy(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(12):  # chains: each like the one before, less and less like the first
        w = [f"{x}c{k}" for x in base]
        for step in range(6):
            texts.append(" ".join(w))
            w = w[:]
            w[10 * step % 60] = f"x{k}{step}"
    texts += ["", None, "one", "One!", "two words", None, "one"]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(i, texts[j]) for i, j in enumerate(order)]
    kept, want = [], set()
    for i, t in rows:
        s = shingle_set(t)
        if s and any(len(s & k) / len(s | k) >= 0.9 for k in kept):
            continue
        want.add(i)
        if s:
            kept.append(s)
    df = spark.createDataFrame([(*x, True, "x") for x in rows], "doc_id long, text string, kept boolean, id string")
    got = near_dedupe(df, "doc_id", "text").collect()
    assert len(got) == len(rows) and {x.doc_id for x in got if x.kept} == want and 12 < len(want) < len(rows) - 12
    assert near_dedupe(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(RuntimeError):
        near_dedupe(df, "doc_id", "text", rounds=1)


def test_hot_shingles_are_split(spark):
    from postloom.operators.dedup import similar_pairs

    sets = spark.createDataFrame([(i, [f"a{j}" for j in range(10)] + [f"b{i % 3}"]) for i in range(40)], "id long, items array<string>")
    pairs = lambda hot: {(r.a, r.b) for r in similar_pairs(sets, 0.8, hot).collect()}
    assert pairs(3) == pairs(10**6) and len(pairs(3)) == 40 * 39 // 2


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from postloom.session import clear_scratch, materialise

    df = materialise(spark.range(3).toDF("id"), "gone")
    folder = Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert folder.exists() and clear_scratch(spark) >= 1 and not folder.exists() and clear_scratch(spark) == 0


def scratch_bytes(spark, query, d):
    """What a query writes to the shared folder."""
    from pathlib import Path

    from postloom import session

    session.clear_scratch(spark)
    query(spark, d).count()
    written = sum(f.stat().st_size for p in session._written[spark.sparkContext.applicationId] for f in Path(p.removeprefix("file://")).rglob("*.parquet"))
    session.clear_scratch(spark)
    return written


def test_near_dedupe_writes_no_texts_or_sets_of_all_rows(spark):
    d = "/root/testdata/sf0.01"
    assert 0 < scratch_bytes(spark, cl.near_dedupe_documents, d) < 4 * 117_824  # four times documents.parquet


def test_signatures_lose_no_similar_sets():
    import numpy as np

    from postloom.operators import dedup

    r = np.random.default_rng(5)
    for least in (0.85, 0.9, 0.95):
        for n in (1, 2, 3, 5, 8, 12, 20, 33, 60, 120, 400):
            for _ in range(30):
                a = r.integers(0, 2**63, n, dtype=np.uint64)
                most = int(n * (1 - least) / least)  # a grows, or loses and gains, as much as it may
                b = np.r_[a, r.integers(0, 2**63, r.integers(0, most + 1), dtype=np.uint64)] if r.random() < 0.5 else np.r_[a[r.integers(0, int(n * (1 - least)) + 1) :], r.integers(0, 2**63, 1, dtype=np.uint64)]
                if len(np.intersect1d(a, b)) < least * len(np.union1d(a, b)):
                    continue
                h, size = np.r_[np.sort(a), np.sort(b)], np.array([len(a), len(b)])
                row, sig = dedup._signatures(h, size, least)
                assert set(sig[row == 0]) & set(sig[row == 1])


def test_cleaning_in_full_cleans_each_post_once(spark, sf):
    """What near-duplicate removal reads, and what is left of it, is one written table."""
    files = cl.clean_fully(spark, sf).inputFiles()
    assert files and not [f for f in files if "golden_input" in f]
