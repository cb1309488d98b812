"""Problems 1 and 4: forms, pairs against brute force, counts against a plain recount."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.llm.canonical import canonical, canonical_form, reader, reader_form, same_reading_pairs
from postloom.llm.terms import Changes, TermCounts, changes, new_counts


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｋｕｌａｎｇ", "kulang"), ("ﬁne", "fine"), ("café", "café"), ("a​b⁠c­", "abc"), ("a b c　d", "a b c d"),
        ("раураl", "paypal"), ("a\r\nb c", "a\nb\nc"), ("", ""), ("​", ""), ("x\ty", "x y"), ("ñ", "ñ"),
    ],
)
def test_reader_forms(a, b):
    assert reader_form(a) == b


@pytest.mark.parametrize(("a", "b"), [("Ñ", "N"), ("A", "a"), ("a.", "a!"), ("a b", "a\nb"), ("1", "l"), ("👩‍🔬", "👩🔬"), ("x", "x ")])
def test_stay_apart(a, b):
    assert reader_form(a) != reader_form(b)


def test_canonical_folds_case():
    assert canonical_form("STRASSE Ｎｏ") == canonical_form("straße no")
    assert canonical_form("КВМНТ") == canonical_form("квмнт") == "kbmht" and canonical_form("ΡΥΝ") == canonical_form("ρυν")
    assert reader_form("нет") != reader_form("het") and reader_form("ёж") == "ëж"


_LETTERS = "".join(chr(c) for a, b in ((0x400, 0x481), (0x48A, 0x52F), (0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x386, 0x386), (0x388, 0x38A), (0x38E, 0x3A1), (0x3A3, 0x3FF), (0x531, 0x556), (0x561, 0x587)) for c in range(a, b + 1) if chr(c).isalpha())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=_LETTERS + " ", max_size=12))
def test_case_makes_no_difference_in_any_script(t):
    assert canonical_form(t.upper()) == canonical_form(t.lower()) == canonical_form(t)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=_LETTERS + "abNVu \u0301\u0308", max_size=8), st.text(alphabet=_LETTERS + "abNVu \u0301\u0308", max_size=8))
def test_what_reads_the_same_has_one_canonical_form(a, b):
    if reader_form(a) == reader_form(b):
        assert canonical_form(a) == canonical_form(b)
    assert canonical_form(reader_form(a)) == canonical_form(a)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_forms_are_stable(t):
    assert reader_form(reader_form(t)) == reader_form(t)
    assert canonical_form(canonical_form(t)) == canonical_form(t)


def test_pairs_against_brute_force(spark):
    texts = ["kape po", "кape po", "kape po", "Kape po", "kape po", None, "", "​", " ", "　", "jalapeño", "jalapeño", "jalapeno", "a" * 100_000, "ａ" + "a" * 99_999]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "row_id long, text string, id string, key string")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if a is not None and b is not None and a != b and reader_form(a) == reader_form(b)}
    got = {(r.a, r.b) for r in same_reading_pairs(df, "row_id", "text").collect()}
    assert got == want and len(want) >= 6
    assert {(r.a, r.b) for r in same_reading_pairs(df, "row_id", "text", hot=2).collect()} == want
    assert same_reading_pairs(df.limit(0), "row_id", "text").count() == 0
    r = df.select(canonical("text").alias("c"), reader("text").alias("r")).collect()
    assert r[5].c is None and r[5].r is None and r[3].c == r[0].c


def recount(texts):
    occ, rec = Counter(), Counter()
    for t in texts:
        ws = re.findall("[a-z]+", (t or "").lower())
        occ.update(ws)
        rec.update(set(ws))
    return {w: (occ[w], rec[w]) for w in occ}


def test_deltas_against_recount(spark):
    states = [
        [(1, "a b a"), (2, None), (3, "")],
        [(1, "a b a"), (2, "c c"), (3, ""), (4, "B d")],
        [(1, "b"), (4, "B d"), (5, "b " * 1000), (6, "x"), (6, "x")],
        [],
    ]
    path = new_counts(spark).path
    before = spark.createDataFrame([], "id long, t string")
    for rows in states:
        after = spark.createDataFrame(rows, "id long, t string")
        delta = changes(before, after, "id", "t")
        TermCounts(spark, path).merge(Changes("f", delta, F.regexp_extract_all(F.lower("t"), F.lit("([a-z]+)"), F.lit(1))))
        counts = TermCounts(spark, path)  # opened anew
        assert {r.term: (r.n_occurrences, r.n_records) for r in counts.counts().collect()} == recount([t for _, t in rows])
        assert counts.totals().first().n_records == len(rows)
        before = after
    assert counts.version == len(states)


def _words(rows, sign=1):
    return Changes("f", rows.withColumn("sign", F.lit(sign)), F.array_compact(F.array("word")), ["topic"])


def test_marks_and_shared_records(spark):
    rows = [(i // 2, "common" if i % 2 else f"w{i % 6}") for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "topic int, word string")
    n = df.select("topic").distinct().count()
    c = new_counts(spark).merge(_words(df))
    by = defaultdict(set)
    for t, w in rows:
        if w:
            by[w].add(t)
    assert {r.term: r.n_records for r in c.counts().collect()} == {w: len(v) for w, v in by.items()}
    assert c.totals().first().n_records == n
    assert {(r.term, r.mark) for r in c.marks().collect()} == {(w, "common") for w, v in by.items() if len(v) > 0.1 * n}


def test_a_record_counts_until_its_last_row_is_gone(spark):
    make = lambda *rows: spark.createDataFrame(rows, "topic int, word string")
    c = new_counts(spark).merge(_words(make((1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"))))
    got = lambda: {r.term: (r.n_occurrences, r.n_records) for r in TermCounts(spark, c.path).counts().collect()}
    assert got() == {"a": (4, 3), "b": (1, 1)} and c.totals().first().n_records == 3
    c.merge(_words(make((1, "a")), -1))
    assert got() == {"a": (3, 3), "b": (1, 1)}
    c.merge(_words(make((1, "a"), (1, "b")), -1))
    assert got() == {"a": (2, 2)} and c.totals().first().n_records == 2


def test_only_touched_buckets_are_written(spark):
    each = F.split("word", " ")
    words = " ".join(f"w{i}" for i in range(400))
    make = lambda w: Changes("f", spark.createDataFrame([(w,)], "word string").withColumn("sign", F.lit(1)), each)
    c = new_counts(spark).merge(make(words)).merge(make("w7"))
    versions = sorted(v for _, _, v, _ in c._manifest("counts"))
    assert len(versions) == 8 and versions == [1] * 7 + [2]
    assert {r.term: r.n_occurrences for r in c.counts().where("n_occurrences > 1").collect()} == {"w7": 2} and c.counts().count() == 400
    assert c.expire() == 3 and c.counts().count() == 400  # a bucket, the totals and the manifest of the first version
    empty = c.merge(Changes("f", spark.createDataFrame([], "word string, sign int"), each))
    assert empty.version == 3 and empty.counts().count() == 400


def test_buckets_grow_with_the_terms(spark, monkeypatch):
    monkeypatch.setattr("postloom.llm.terms.TERMS_PER_BUCKET", 10)
    each = F.split("word", " ")
    c = new_counts(spark)
    for k in range(3):
        c.merge(Changes("f", spark.createDataFrame([(" ".join(f"w{i}" for i in range(k * 100, k * 100 + 100)),)], "word string").withColumn("sign", F.lit(1)), each))
    assert {h[1] for h in c._manifest("counts")} == {20} or min(h[1] for h in c._manifest("counts")) > 10
    assert c.counts().count() == 300 and c.counts().where("n_occurrences <> 1").count() == 0
