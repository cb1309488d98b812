"""Sources, sinks and streams on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from postloom.sources import html_pages, json_files, sinks
from postloom.streaming import incremental as inc


def test_jsonl_modes(spark, tmp_path):
    p = tmp_path / "CW-01.jsonl"
    p.write_text('{"post_id": "a", "text": "x", "engagement": {"reactions": "1.2K"}}\n\n{"post_id": "b", "te\n')
    assert [r.post_id for r in json_files.read_jsonl(spark, str(p), json_files.POST, "drop").where("post_id IS NOT NULL").collect()] == ["a"]
    kept = json_files.read_jsonl(spark, str(p), json_files.POST, "keep").cache()
    assert kept.where("_malformed IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt"):
        json_files.read_jsonl(spark, str(p), json_files.POST).collect()
    (tmp_path / "XX.jsonl").write_text('{"post_id": "c"}\n')
    known = spark.createDataFrame([("CW-01",)], "source_code string")
    assert {(r.source_code, r.post_id) for r in json_files.read_by_source(spark, str(tmp_path), json_files.POST, known).where("post_id IS NOT NULL").collect()} == {("CW-01", "a")}
    (tmp_path / "a.json").write_text('[{"post_id": "q"}, {"post_id": "r"}]')
    assert json_files.read_json_array(spark, str(tmp_path / "a.json"), json_files.POST).count() == 2


def test_lines_and_yaml(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# c\n a \n\nb\n")
    assert [r.value for r in json_files.read_lines(spark, str(tmp_path / "w.txt")).collect()] == ["a", "b"]
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- {code: x, region: 1}\n- {code: y, region: 2}\n")
    (tmp_path / "b.yaml").write_text("- {code: y, region: 3}\n- {code: z, region: 4}\n")
    r = json_files.read_yaml_table(spark, str(tmp_path / "a.yaml"), "code string, region int", str(tmp_path / "b.yaml"), "code")
    assert sorted(tuple(x) for x in r.collect()) == [("x", 1), ("y", 3), ("z", 4)]


def test_bodies_paths_objects(spark):
    df = spark.createDataFrame([(1, '{"a": [{"id": 1, "t": "x"}, {"id": 2}]}'), (2, '{"id": 3, "t": "y"}\nbad\n{"id": 4}'), (3, None)], "i long, b string")
    assert [len(r[0]) for r in df.select(json_files.json_bodies(F.col("b"))).collect()] == [1, 2, 0]
    o = json_files.find_objects(df, "i", "b", ["id"]).collect()
    assert {(r.i, r.path) for r in o} == {(1, "$.a[0]"), (1, "$.a[1]")}
    assert {(r.path, r.n) for r in json_files.key_paths(df.where("i = 1"), "b").collect()} == {("$", 1), ("$.a", 1), ("$.a[]", 2), ("$.a[].id", 2), ("$.a[].t", 1)}
    d = spark.createDataFrame([("", "m", None), ("t", "m", None)], "text string, message string, x string")
    assert [r[0] for r in d.select(json_files.first_of("text", "message")).collect()] == ["m", "t"]
    name, best = json_files.largest_fallback({"a": spark.range(2), "b": spark.range(5), "c": spark.range(9)}, 5)
    assert name == "b" and best.count() == 5


def test_html(spark):
    page = "<div role=article><p class=post-text>A &amp; b<br>c</p><span class=reactions>1,2K</span><span class='comments'>1.5K</span><a class=permalink href=/x>l</a><time datetime='2024-01-01'>1d</time></div><a rel=next href=/n>n</a>"
    r = html_pages.parse_pages(spark.createDataFrame([(1, page), (2, None), (3, "plain")], "i long, h string"), "i", "h").collect()
    assert len(r) == 1 and (r[0].text, r[0].comments, r[0].url, r[0].stamp, r[0].next_page) == ("A & b\nc", 1500, "/x", "2024-01-01", "/n")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, s string")
    path = f"file://{tmp_path}/t"
    assert sinks.append_new(df, path, "id") == 2 and sinks.append_new(df, path, "id") == 0 and spark.read.parquet(path).count() == 2
    sinks.write_partitioned(df, f"file://{tmp_path}/p", "s")
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["s=a", "s=b"]
    kept, rej = sinks.split_rejects(df.withColumn("why", F.when(F.col("id") == 1, "x")), "why", "s")
    assert kept.count() == 2 and rej.first().text_preview == "a"
    assert sinks.report_table(df.limit(1)).splitlines()[0] == "| id | s |"


def test_stream_resumes_and_repeats(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("src", "out", "ck"))
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    a.write.parquet(src)
    step = lambda: inc.run_now(inc.first_seen(inc.read_new(spark, src, a.schema), "k"), ck, each=inc.upsert_once(out, "k"))
    step()
    spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int").write.mode("append").parquet(src)
    step()
    step()
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    batch = spark.createDataFrame([("c", 3), ("d", 4)], "k string, v int")
    inc.upsert_once(out, "k")(batch, 7)
    inc.upsert_once(out, "k")(batch, 7)
    assert spark.read.parquet(out).count() == 4


def test_late_rows_and_markers(spark, tmp_path):
    src = f"file://{tmp_path}/ev"
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' ts, 'x' t UNION ALL SELECT timestamp'2024-01-02 10:00:00', 'x'").write.parquet(src)
    schema = spark.read.parquet(src).schema
    days = inc.window_counts(inc.read_new(spark, src, schema), "ts", "1 day", ["t"], late="1 hour")
    inc.run_now(days, f"file://{tmp_path}/ck2", sink=f"file://{tmp_path}/days")
    assert [r.n for r in spark.read.parquet(f"file://{tmp_path}/days").collect()] == [1]  # the last window is still open
    marks = f"file://{tmp_path}/marks"
    inc.mark_complete(spark, marks, "CW-01", 5)
    (tmp_path / "marks" / "torn.json").write_text('{"partition": "CW')
    assert [(r.partition, r.n) for r in inc.completed(spark, marks).collect()] == [("CW-01", 5)]
    assert json.loads("1") == 1


def test_registry_runs_without_llm(spark):
    from postloom.plans import registry

    q, s = registry.queries(), registry.oracle_sql()
    assert len(q) > 80 and set(s) <= set(q) and not any(k.startswith(("p1_", "p3_")) for k in q)
