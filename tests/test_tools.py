"""Functions for display, JSON redaction, the resilient client, the command line, and sources that warn."""

import json
import warnings

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import __main__ as cli
from postloom.functions import jsonx as J
from postloom.functions import text as X
from postloom.operators.scores import parse_answer
from postloom.plans.tools import PAGE_LINES
from postloom.sources.json_files import POST, read_by_source, read_lines


def test_resilient_client():
    calls, slept = [], []

    def flaky(values):
        calls.append(values)
        if len(calls) in (1, 2) or values == ["bad"]:
            raise OSError("gone")
        return [v.upper() for v in values]

    c = J.Resilient(flaky, tries=3, pause=1.0, breaker=2, rest=1, sleep=slept.append)
    assert c(["a", "b"]) == ["A", "B"] and len(calls) == 3 and slept == [1.0, 2.0]
    assert c(["bad"]) == [None] and c(["bad"]) == [None]
    n = len(calls)
    assert c(["a"]) == [None] and len(calls) == n  # the breaker is open for one call
    assert c(["a"]) == ["A"]
    assert J.Resilient(lambda v: [], tries=1)(["x"]) == [None]
    now = [0.0]
    paced = J.Resilient(lambda v: v, per_minute=60, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    for _ in range(3):
        paced([1])
    assert now[0] == pytest.approx(2.0)


def test_with_client(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    got = J.with_client(df, "t", lambda: J.Resilient(lambda vs: [None if v is None else v * 2 for v in vs], tries=1), "answer", T.StringType()).collect()
    assert {(r.t, r.answer) for r in got} == {("a", "aa"), (None, None), ("b", "bb")}
    assert J.with_client(df.limit(0), "t", lambda: list, "answer", T.StringType()).count() == 0


def test_grid_search():
    tried = [{"k": k} for k in (2, 3, 5)]
    score = lambda c: {"score": {2: 0.9, 3: 0.5, 5: 0.5}[c["k"]], "n_clusters": c["k"]}
    assert J.grid_search(tried, score, 3)["k"] == 3 and J.grid_search(tried, score, 9)["k"] == 2
    with pytest.raises(ValueError):
        J.grid_search([], score, 1)


def test_json_redaction(spark):
    doc = {"a": {"b": "x", "c": None}, "l": [{"b": 1}, {"b": 2}], "m": {"p": {"b": 3}, "q": {"b": 4}}}
    df = spark.createDataFrame([(json.dumps(doc),), ("no json",), (None,)], "j string")
    r = df.select(J.redact_paths("j", ["a.b", "a.c", "l.b", "m.*.b", "zz.y"]).alias("r"), J.hash_fields("j", ["l"]).alias("h")).collect()
    got = json.loads(r[0].r)
    assert got["a"] == {"b": "[REDACTED]", "c": None} and [x["b"] for x in got["l"]] == ["[REDACTED]"] * 2 and got["m"]["q"]["b"] == "[REDACTED]"
    h = json.loads(r[0].h)
    assert "l" not in h and len(h["l_sha256"]) == 64 and r[1].r is None and r[1].h is None and r[2].r is None


def test_display(spark):
    df = spark.createDataFrame([("entry 12 – Hi <b> & [REDACTED_NAME]",), ("Re-entry 12",), (None,)], "t string")
    got = [r[0] for r in df.select(X.highlight_tags(X.escape_html(J.strip_entry_prefix(F.col("t"))))).collect()]
    assert got == ["Hi &lt;b&gt; &amp; <mark>[REDACTED_NAME]</mark>", "Re-entry 12", None]
    t = spark.createDataFrame([("Like\n\n  first line\nsecond  \n3 comments\n",), ("Like\nok\n",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(X.longest_block(F.col("t"), PAGE_LINES)).collect()] == ["first line\nsecond", None, None, None]
    a = spark.createDataFrame([(100, 100), (100, 700), (100, 90_100), (0, 86400 * 15), (None, 5)], "e long, n long")
    assert [r[0] for r in a.select(J.ago(F.col("e"), F.col("n"))).collect()] == ["just now", "10m", "1d", "2w", None]


def test_words_are_literal_and_cased(spark):
    df = spark.createDataFrame([("Ana ana C.D. CxD.",)], "t string")
    r = df.select(X.redact_words(F.col("t"), ["Ana"], any_case=False).alias("a"), X.redact_words(F.col("t"), ["Ana"]).alias("b"), X.redact_words(F.col("t"), ["C.D"]).alias("c")).first()
    assert r.a == "[REDACTED] ana C.D. CxD." and r.b == "[REDACTED] C.D. CxD." and r.c == "Ana ana [REDACTED]. CxD."


def test_leaks(spark):
    df = spark.createDataFrame([("the lab of Hall A",), ("computer lab",), ("",)], "t string")
    assert [r[0] for r in df.select(J.leak_count(F.col("t"), ["computer lab"], [r"\blab\b", r"\bHall\b"])).collect()] == [2, 0, 0]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("[{'id': 'p1', 'V': 3, 'A': 4, 'D': 5, 'sarcasm': True}]", 1), ('[{"id": "p1", "V": 3, "A": 4, "D": 5,},]', 1), ('here: [{"id": "p1", "V": 3, "A": 4, "D": 5}, {"id": "p2", "V": 1, "A": 1, "D": 1', 2),
        ("{id: 'p1', V: 3, A: 4, D: 5}", 1), ("nothing", None), ("", None), (None, None), ('[{"id": "p1"}]', None),
    ],
)
def test_repaired_answers(spark, text, n):
    r = spark.createDataFrame([(text,)], "t string").select(parse_answer(F.col("t"), repair=True).alias("r")).first().r
    assert (r is None) if n is None else (len(r) == n and (r[0].id, r[0].v, r[0].a, r[0].d) == ("p1", 3, 4, 5))


def test_sources_warn_and_fail(spark, tmp_path):
    for code in ("AA", "ZZ"):
        (tmp_path / f"{code}.jsonl").write_text('{"post_id": "1", "text": "x"}\n')
    known = spark.createDataFrame([("AA",)], "source_code string")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert read_by_source(spark, str(tmp_path), POST, known).count() == 1
    assert any("ZZ" in str(x.message) for x in w)
    (tmp_path / "AA.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_by_source(spark, str(tmp_path), POST, malformed="fail").collect()
    assert read_by_source(spark, str(tmp_path), POST, malformed="drop").count() == 1
    (tmp_path / "words.txt").write_text("\t one \n# no\n \n two\n")
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "words.txt")).collect()) == ["one", "two"]


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "p6_found" in capsys.readouterr().out.split()
    assert cli.main(["run", "glossary", "--data", sf, "--out", str(tmp_path / "g"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "g")).count() == 48
    assert cli.main(["explain", "glossary", "--data", sf]) == 0
    assert cli.main(["clean", "--data", sf, "--out", str(tmp_path / "c"), "--phases", "1,3,7,10"]) == 0
    n = spark.read.parquet(f"{sf}/golden_input.parquet").count()
    assert spark.read.parquet(str(tmp_path / "c/kept")).count() + spark.read.parquet(str(tmp_path / "c/rejected")).count() == n
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "--data", sf, "--out", "x"])
