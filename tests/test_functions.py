"""Vectors and edges of the column functions."""

import re

import pytest
from pyspark.sql import functions as F

from postloom.functions import numbers as N
from postloom.functions import text as T
from postloom.functions import times as M


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("a", "b"), [("haaaay", "haaay"), ("sobrangggg", "sobranggg"), ("aaa", "aaa"), ("", ""), (None, None), ("!!!!!", "!!!")])
def test_repeats(spark, a, b):
    assert one(spark, a, T.collapse_repeats) == b


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("hello   \n\t world", "hello world"),
        ("body text\nSubmitted: October 6, 2025", "body text"),
        ("see you on March 15 at 8pm", "see you on March 15 at 8pm"),
        ("posted March 31, 7:53:56 PM UTC here", "posted here"),
        ("go to https://x.example/a?b now", "go to now"),
        ("call 0917-123-4567 or +639171234567", "call or"),
        ("id 20251234 #Tag85 ok....", "id ok"),
        ("the rest .... See more", "the rest"),
        (None, None), ("", ""), ("   ", ""),
    ],
)
def test_noise(spark, a, b):
    assert one(spark, a, T.noise_clean) == b


def test_tags_titles_departments(spark):
    assert one(spark, "[A] [A]  [A] b [B]", T.collapse_tags) == "[A] b [B]"
    assert one(spark, "si Prof. Juan Reyes ay", T.redact_titles) == "si [REDACTED_NAME] ay"
    assert one(spark, "sa CCS at #CCS, CCSX", lambda c: T.redact_departments(c, ["CCS"])) == "sa [DEPARTMENT] at #CCS, CCSX"
    assert one(spark, "Bad bad word", lambda c: T.redact_words(c, ["bad"], "[T]")) == "[T] word"
    assert one(spark, "x AB y #AB", lambda c: T.replace_rules(c, [(T.acronym_pattern("AB"), "[S]"), (r"\[S\]", "[R]")])) == "x [R] y #AB"
    assert one(spark, "a [NCR] b [Region I]", T.strip_placeholders) == "a b [Region I]"


@pytest.mark.parametrize(("a", "b"), [("students", "student"), ("children", "child"), ("stories", "story"), ("classes", "class"), ("boxes", "box"), ("this", "this"), ("bus", "bus"), ("gas", "gas"), ("churches", "church")])
def test_singular(spark, a, b):
    assert one(spark, a, T.singular) == b


def test_labels_and_lines(spark):
    lazy = lambda s: one(spark, s, T.is_lazy)
    assert lazy("") and lazy(None) and lazy("General talk") and lazy("Topic 12") and lazy("no theme") and not lazy("Dorm Water")
    assert one(spark, "“'x y'”", T.unquote) == "x y"
    assert one(spark, "a b c d", lambda c: T.first_words(c, 2)) == "a b"
    assert one(spark, "a=1&b=x%20y", T.form_fields) == {"a": "1", "b": "x y"}
    assert one(spark, "Like\n\nthe text\n12 comments", lambda c: T.noise_lines(c, ["^Like$", r"^\d+ comments$"])) == "the text"
    assert one(spark, "abcdef", lambda c: T.tail(c, 3, "+")) == "def+" and one(spark, "ab", lambda c: T.tail(c, 3, "+")) == "ab"
    assert one(spark, "abcdef", lambda c: T.head(c, 3)) == "abc…"


@pytest.mark.parametrize(("n", "want"), [("a b c", ["a b c"]), ("a b c d e f", ["a b c d e", "b c d e f"]), ("", [])])
def test_shingles(spark, n, want):
    assert one(spark, n, lambda c: T.shingles(T.words(c, "[a-z]+"), 5)) == want


@pytest.mark.parametrize(
    ("a", "b"),
    [(None, 0), ("", 0), ("1.2K", 1200), ("2M", 2_000_000), ("17", 17), ("3.9", 3), ("-4", 0), ("inf", 0), ("n/a", 0), ("true", 1), ("1e30", 0), (" 5 ", 5)],
)
def test_counts(spark, a, b):
    assert one(spark, a, N.as_count) == b
    assert one(spark, "1,234", N.scraped_count) == 1234


def test_scores_and_bands(spark):
    q = "SELECT 12 AS v, 0 AS a, CAST(NULL AS INT) AS d, true AS s"
    r = spark.sql(q).select(N.clamp_flags(F.col("v"), F.col("a"), F.col("d"), F.col("s")).alias("f"), N.clamp(F.col("v")).alias("v")).first()
    assert r.f == ["range_clamped", "v_clamped", "a_clamped", "d_missing", "sarcasm_high_valence"] and r.v == 9
    assert [one(spark, x, N.score_number) for x in ("3.7", '"3.7"', '"x"', None, "-2.5")] == [3, 4, None, None, -2]
    assert [one(spark, x, N.tone, "int") for x in (1, 5, 9, None)] == ["negative", "ambivalent", "ironic_praise", None]
    assert one(spark, [3, 1, 2, 10], N.upper_median, "array<int>") == 3 and one(spark, [], N.upper_median, "array<int>") is None
    assert one(spark, [5, 5, 5], N.gini, "array<int>") == pytest.approx(0) and one(spark, [0, 0, 9], N.gini, "array<int>") == pytest.approx(2 / 3)
    assert one(spark, [], N.gini, "array<int>") == 0 and one(spark, -1, lambda c: N.ring_index(c, 15), "int") == 14
    assert [one(spark, x, N.delta_direction, "double") for x in (0.001, 0.2, -0.2, None)] == ["flat", "better", "worse", "none"]
    assert [one(spark, x, N.size_tier, "int") for x in (10, 2000, 9000, None)] == ["small", "medium", "large", None]


def test_times(spark):
    rel = lambda s: one(spark, s, lambda c: M.relative_epoch(c, F.lit(1_000_000)))
    assert [rel(x) for x in ("3h", "2 d", "1w", "45m", "just now", "yesterday", "5 mins ago", "June 2", None, "")] == [989_200, 827_200, 395_200, 997_300, 1_000_000, 913_600, 999_700, None, None, None]
    assert one(spark, 1717226003, M.month_key, "long") == "2024-06" and one(spark, 1717226003, M.wall_iso, "long") == "2024-06-01T15:13:23+08:00"
    assert one(spark, 5, lambda c: M.valid_epoch(c, 0, 4), "long") is None
    r = spark.sql("SELECT 1717226003 a, 1719999999 b").select(M.month_span(F.col("a"), F.col("b")).alias("x"), M.month_span(F.col("a"), F.col("a")).alias("y")).first()
    assert r.x == "June 2024 — July 2024" and r.y == "June 2024"


def test_chart_terms(spark):
    got = one(spark, "The [photo] students' boxes https://x.y 123 ab Story", lambda c: T.chart_terms(c, ["the"]))
    assert got == ["student", "box", "story"] and one(spark, None, lambda c: T.chart_terms(c, ["the"])) == []
    assert re.fullmatch("[0-9a-f]{16}", one(spark, " Abc ", T.content_id)) and one(spark, " Abc ", T.content_id) == one(spark, "abc", T.content_id)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I have to go to the library and study for the exam", "English"),
        ("Ang hirap naman ng buhay dito sa atin kasi wala po akong pera", "Filipino"),
        ("Grabe ang hirap ng exam but I still have to be here with my friends", "Taglish"),
        ("Naa koy pangutana kay dili ko kasabot aron nga mag-eskwela", "Cebuano"),
        ("ok", "Unknown"),
    ],
)
def test_language_rule(spark, tmp_path, text, want):
    from postloom.plans.posts import language_rule

    spark.createDataFrame([(1, text)], "row_id long, text string").write.parquet(f"file://{tmp_path}/golden_input.parquet")
    assert [r.language for r in language_rule(spark, f"file://{tmp_path}").collect()] == [want]
