"""Nested records to flat tables: shapes, edges and a slow independent walk over the raw payloads."""

import json

from postloom.operators.nested import conform, find_records, flatten_records, infer_merged_schema, resolve, spark_type, without_records
from postloom.plans.nested_labels import found


def slow_rows(payload):
    """(topic, child, no, amount) of a payload by plain recursion."""
    v = json.loads(payload)
    labels = v if isinstance(v, list) else v.get("labels", [v])
    for lab in labels if isinstance(labels, list) else [labels]:
        t = int(lab["topic_id"])
        m = lab.get("response_meta") or {}
        m = json.loads(m) if isinstance(m, str) else m
        tries = m.get("attempts") or []
        if isinstance(tries, dict):
            tries = [tries[k] for k in sorted(tries, key=int)] if all(k.isdigit() for k in tries) else [tries]
        for no, x in [(0, m), *enumerate(tries, 1)]:
            n = ((x or {}).get("usage") or {}).get("prompt_tokens")
            if n is not None:
                yield t, "usage", no, int(n)
        s = lab.get("temporal_signature") or {}
        if s.get("n_with_timestamp") is not None:
            yield t, "signature", 0, int(s["n_with_timestamp"])
        d = s.get("monthly_distribution") or {}
        for k, n in d.items() if isinstance(d, dict) else [(x["month"], x["count"]) for x in d]:
            yield t, "month", int(k.replace("-", "")), int(n)


def test_found_against_plain_walk(spark):
    sf = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{sf}/label_raw.parquet").collect()
    want = {(r.record_id, *x) for r in raw for x in slow_rows(r.payload)}
    ids = {r.record_id for r in raw}
    got = {tuple(r) for r in found(spark, sf).select("record_id", "topic_id", "child", "child_no", "amount").collect() if r.record_id in ids}
    assert got == want and len(want) > 50


def test_shapes_merge(spark):
    texts = [
        '{"k": 1, "xs": [{"a": 1}, null, {"a": "2"}], "m": {"2024-01": 3}}',
        '[{"k": "2", "xs": {"a": 5}, "m": [{"month": "2024-02", "count": "4"}]}]',
        '{"meta": {"run": "7"}, "recs": [{"k": 3, "xs": {"1": {"a": 8}, "10": null, "2": {"a": 9}}, "m": null}]}',
        '{"k": 4, "xs": "[{\\"a\\": 6}]", "m": {}}',
        None, "", "no json", '{"other": 1}', "[]", 'Here it is: [{"k": 5, "xs": []}] done',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    shape = infer_merged_schema(df, "j", "k")
    assert spark_type(shape).simpleString() == "struct<k:bigint,xs:array<struct<a:bigint>>,m:map<string,bigint>>"
    r = {x.id: x for x in conform(df, "j", ["id"], "k", shape).collect()}
    assert sorted(r) == [0, 1, 2, 3, 9] and r[2].context["meta.run"] == "7"
    assert [x and x.a for x in r[2].record.xs] == [8, 9, None] and [x.a for x in r[3].record.xs] == [6]
    t = flatten_records(conform(df, "j", ["id"], "k", shape).select("id", "record.*"), "rec", ["id"])
    assert {(x.id, x._ord, x.a) for x in t["rec.xs"].collect()} == {(0, 1, 1), (0, 2, None), (0, 3, 2), (1, 1, 5), (2, 1, 8), (2, 2, 9), (2, 3, None), (3, 1, 6)}
    assert {(x.id, x._key, x.value) for x in t["rec.m"].collect()} == {(0, "2024-01", 3), (1, "2024-02", 4)}
    assert t["rec"].count() == 5
    assert {x.id for x in without_records(df, t["rec"], ["id"]).collect()} == {4, 5, 6, 7, 8}


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "id long, j string")
    assert conform(empty, "j", ["id"], "k", infer_merged_schema(empty, "j", "k")).count() == 0
    df = spark.createDataFrame([(1, ({"b": 1},), 2)], "id long, a struct<b:map<string,int>>, a__b int")
    t = flatten_records(df, "t", ["id"])
    assert t["t"].columns == ["id", "_id", "a__b"] and t["t.a__b"].first()._key == "b"
    df = spark.createDataFrame([(1, (5,), 2)], "id long, a struct<b:int>, a__b int")
    assert flatten_records(df, "t", ["id"])["t"].columns == ["id", "_id", "a__b", "a__b_2"]
    assert resolve({"kinds": ["null"], "fields": None, "items": None, "map": None}) == {"shape": "scalar", "type": "string"}
    assert list(find_records(None, "k")) == []


def test_repeats_and_long_text(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (1, '{"k": 1}'), (2, '{"k": 2, "t": "' + "x" * 200_000 + '"}')], "id long, j string")
    r = conform(df, "j", ["id"], "k", infer_merged_schema(df, "j", "k")).collect()
    assert len(r) == 3 and max(len(x.record.t or "") for x in r) == 200_000
