"""The label records of topic_labels and label_raw as flat tables: labels, usages, attempts, signatures, months."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.io import table
from postloom.operators.nested import conform, flatten_records, infer_merged_schema
from postloom.session import materialise

KEYS, CARRY = ["record_id", "label_no"], ("topic_id",)


def _typed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    df = table(spark, sf_dir, "topic_labels").withColumn("label_no", F.lit(1).cast("bigint"))
    return flatten_records(df, "labels", KEYS, CARRY)


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = table(spark, sf_dir, "label_raw", "record_id", "payload")
    shape = infer_merged_schema(raw, "payload", "topic_id")
    records = conform(raw, "payload", ["record_id"], "topic_id", shape).select("record_id", F.col("_record_no").alias("label_no"), "record.*")
    # Parsed once, for all child tables.
    return flatten_records(materialise(records, "label-records"), "labels", KEYS, CARRY)


def _pick(t: DataFrame | None, **columns: tuple[str, str]) -> DataFrame | None:
    """The named columns, null where the table lacks them."""
    if t is None:
        return None
    return t.select(*[(F.expr(f"try_cast(`{name}` AS {kind})") if name in t.columns else F.lit(None).cast(kind)).alias(a) for a, (name, kind) in columns.items()])


USAGE = {f"{k}_tokens": (f"usage__{k}_tokens", "bigint") for k in ("prompt", "total", "completion")}
HEAD = {"record_id": ("record_id", "bigint"), "label_no": ("label_no", "bigint"), "topic_id": ("topic_id", "int")}


def _tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """labels, usages, attempts, signatures and months of one flattened table, as far as it has them."""
    out = {"labels": _pick(t["labels"], **HEAD, id=("_id", "string"), label=("label", "string"), retries=("retries", "int"), prompt_sha256=("prompt_sha256", "string"))}
    out["usages"] = _pick(t["labels"], **HEAD, **{k: (f"response_meta__{c}", kind) for k, (c, kind) in USAGE.items()}).withColumn("attempt", F.lit(0).cast("bigint"))
    out["signatures"] = _pick(
        t["labels"], **HEAD, n_with_timestamp=("temporal_signature__n_with_timestamp", "bigint"), gini=("temporal_signature__gini", "double"),
        is_event_driven=("temporal_signature__is_event_driven", "boolean"),
    )
    attempts = _pick(t.get("labels.response_meta__attempts"), **HEAD, attempt=("_ord", "bigint"), attempt_no=("attempt_no", "bigint"), status_code=("status_code", "int"), error_code=("error_code", "string"), **USAGE)
    if attempts is not None:
        out["attempts"] = attempts
        out["usages"] = out["usages"].unionByName(attempts.select(*HEAD, *USAGE, "attempt"))
    months = _pick(t.get("labels.temporal_signature__monthly_distribution"), **HEAD, month=("_key", "string"), n=("value", "bigint"))
    if months is not None:
        out["months"] = months
    return out


def label_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """labels, usages, attempts, signatures, months over both tables; each row has record_id, label_no and topic_id."""
    both = [_tables(_typed(spark, sf_dir)), _tables(_raw(spark, sf_dir))]
    return {k: reduce(lambda a, b: a.unionByName(b), [t[k] for t in both if k in t]) for k in both[0].keys() | both[1].keys()}


def _cases(t: dict[str, DataFrame]) -> DataFrame:
    row = lambda df, child, no, amount: df.select("record_id", "topic_id", F.lit(child).alias("child"), no.cast("bigint").alias("child_no"), F.col(amount).alias("amount"))
    parts = [
        row(t["usages"].where("prompt_tokens IS NOT NULL"), "usage", F.col("attempt"), "prompt_tokens"),
        row(t["signatures"].where("n_with_timestamp IS NOT NULL"), "signature", F.lit(0), "n_with_timestamp"),
    ]
    if "months" in t:
        parts.append(row(t["months"].where("n IS NOT NULL"), "month", F.expr("try_cast(replace(month, '-', '') AS bigint)"), "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per usage with prompt_tokens, per signature with n_with_timestamp and per month entry."""
    # Only a raw payload may hold two labels of one topic, whose rows would be alike; a typed record has one label.
    return _cases(_tables(_typed(spark, sf_dir))).unionByName(_cases(_tables(_raw(spark, sf_dir))).distinct())


def part(name: str):
    """A query that returns one of the flat tables. The number of a label in its payload and the surrogate keys stay in ``label_tables``."""
    return lambda spark, sf_dir: label_tables(spark, sf_dir)[name].drop("label_no", "id")


QUERIES = {
    "p2_found": found,
    "p2_labels": part("labels"),
    "p2_usages": part("usages"),
    "p2_attempts": part("attempts"),
    "p2_signatures": part("signatures"),
    "p2_months": part("months"),
}

_RAW = """WITH raw AS (SELECT record_id, payload::JSON p FROM label_raw),
lab AS (
  SELECT record_id, unnest(CASE WHEN json_type(p) = 'ARRAY' THEN p->'$[*]' WHEN json_type(p->'labels') = 'ARRAY' THEN p->'$.labels[*]'
                                WHEN json_type(p->'labels') = 'OBJECT' THEN [p->'labels'] ELSE [p] END) l FROM raw),
one AS (
  SELECT record_id, (l->>'topic_id')::INT topic_id, row_number() OVER () AS k,
         CASE WHEN json_type(l->'response_meta') = 'VARCHAR' THEN (l->>'response_meta')::JSON ELSE l->'response_meta' END m, l->'temporal_signature' s FROM lab),
listed AS (
  SELECT *, CASE WHEN json_type(m->'attempts') = 'ARRAY' THEN m->'$.attempts[*]'
                 WHEN json_type(m->'attempts') = 'OBJECT' AND list_bool_and(list_transform(json_keys(m->'attempts'), lambda x: regexp_full_match(x, '[0-9]+'))) AND len(json_keys(m->'attempts')) > 0
                 THEN list_transform(list_sort(json_keys(m->'attempts')::INT[]), lambda x: json_extract(json_extract(m, '$.attempts'), x::VARCHAR))
                 WHEN json_type(m->'attempts') = 'OBJECT' AND len(json_keys(m->'attempts')) > 0 THEN [m->'attempts'] ELSE []::JSON[] END AS tries,
         CASE WHEN json_type(s->'monthly_distribution') = 'ARRAY' THEN list_transform(json_extract(s, '$.monthly_distribution[*]'), lambda x: {'k': json_extract_string(x, '$.month'), 'n': json_extract_string(x, '$.count')})
              WHEN json_type(s->'monthly_distribution') = 'OBJECT' THEN list_transform(json_keys(s->'monthly_distribution'), lambda x: {'k': x, 'n': json_extract_string(json_extract(s, '$.monthly_distribution'), x)})
              ELSE [] END AS months
  FROM one)"""
SQL = {
    "p2_found": """
""" + _RAW + """,
raw_rows AS (
  SELECT record_id, topic_id, 'usage' child, 0::BIGINT child_no, (m->'usage'->>'prompt_tokens')::BIGINT amount FROM one
  UNION ALL SELECT record_id, topic_id, 'usage', i, (tries[i]->'usage'->>'prompt_tokens')::BIGINT FROM (SELECT *, unnest(generate_series(1, len(tries))) i FROM listed)
  UNION ALL SELECT record_id, topic_id, 'signature', 0, (s->>'n_with_timestamp')::BIGINT FROM one
  UNION ALL SELECT record_id, topic_id, 'month', replace(e.k, '-', '')::BIGINT, e.n::BIGINT FROM (SELECT *, unnest(months) e FROM listed)),
typed AS (
  SELECT record_id, topic_id, 'usage' child, 0::BIGINT child_no, response_meta.usage.prompt_tokens::BIGINT amount FROM topic_labels
  UNION ALL SELECT record_id, topic_id, 'usage', i, a[i].usage.prompt_tokens FROM (SELECT record_id, topic_id, response_meta.attempts a, unnest(generate_series(1, len(response_meta.attempts))) i FROM topic_labels)
  UNION ALL SELECT record_id, topic_id, 'signature', 0, temporal_signature.n_with_timestamp FROM topic_labels
  UNION ALL SELECT record_id, topic_id, 'month', replace(e.key, '-', '')::BIGINT, e.value FROM (SELECT record_id, topic_id, unnest(map_entries(temporal_signature.monthly_distribution)) e FROM topic_labels))
SELECT DISTINCT record_id, topic_id, child, child_no, amount FROM (SELECT * FROM raw_rows UNION ALL SELECT * FROM typed) WHERE amount IS NOT NULL""",
    # The raw labels' numbers follow their order in the payload.
    "p2_usages": _RAW + """,
u AS (SELECT record_id, topic_id, 0::BIGINT AS attempt, m->'usage' AS u FROM one UNION ALL SELECT record_id, topic_id, i, tries[i]->'usage' FROM (SELECT *, unnest(generate_series(1, len(tries))) i FROM listed))
SELECT record_id, topic_id, attempt, (u->>'prompt_tokens')::BIGINT AS prompt_tokens, (u->>'total_tokens')::BIGINT AS total_tokens, (u->>'completion_tokens')::BIGINT AS completion_tokens FROM u
UNION ALL SELECT record_id, topic_id, 0, response_meta.usage.prompt_tokens, response_meta.usage.total_tokens, response_meta.usage.completion_tokens FROM topic_labels
UNION ALL SELECT record_id, topic_id, i, a[i].usage.prompt_tokens, a[i].usage.total_tokens, a[i].usage.completion_tokens FROM (SELECT record_id, topic_id, response_meta.attempts a, unnest(generate_series(1, len(response_meta.attempts))) i FROM topic_labels)""",
    "p2_signatures": _RAW + """ SELECT record_id, topic_id, (s->>'n_with_timestamp')::BIGINT AS n_with_timestamp, (s->>'gini')::DOUBLE AS gini, (s->>'is_event_driven')::BOOLEAN AS is_event_driven FROM one
UNION ALL SELECT record_id, topic_id, temporal_signature.n_with_timestamp, temporal_signature.gini, temporal_signature.is_event_driven FROM topic_labels""",
    "p2_months": _RAW + """ SELECT record_id, topic_id, e.k AS month, e.n::BIGINT AS n FROM (SELECT *, unnest(months) e FROM listed)
UNION ALL SELECT record_id, topic_id, e.key, e.value FROM (SELECT record_id, topic_id, unnest(map_entries(temporal_signature.monthly_distribution)) e FROM topic_labels)""",
    "p2_attempts": _RAW + """ SELECT record_id, topic_id, i AS attempt, try_cast(tries[i]->>'attempt_no' AS BIGINT) AS attempt_no, try_cast(tries[i]->>'status_code' AS INT) AS status_code, tries[i]->>'error_code' AS error_code,
  (tries[i]->'usage'->>'prompt_tokens')::BIGINT AS prompt_tokens, (tries[i]->'usage'->>'total_tokens')::BIGINT AS total_tokens, (tries[i]->'usage'->>'completion_tokens')::BIGINT AS completion_tokens
FROM (SELECT *, unnest(generate_series(1, len(tries))) i FROM listed)
UNION ALL SELECT record_id, topic_id, i, a[i].attempt_no, a[i].status_code, a[i].error_code, a[i].usage.prompt_tokens, a[i].usage.total_tokens, a[i].usage.completion_tokens FROM (SELECT record_id, topic_id, response_meta.attempts a, unnest(generate_series(1, len(response_meta.attempts))) i FROM topic_labels)""",
    "p2_labels": _RAW + """, l AS (SELECT record_id, unnest(CASE WHEN json_type(p) = 'ARRAY' THEN p->'$[*]' WHEN json_type(p->'labels') = 'ARRAY' THEN p->'$.labels[*]' WHEN json_type(p->'labels') = 'OBJECT' THEN [p->'labels'] ELSE [p] END) AS l FROM raw)
SELECT record_id, (l->>'topic_id')::INT AS topic_id, l->>'label' AS label, (l->>'retries')::INT AS retries, l->>'prompt_sha256' AS prompt_sha256 FROM l
UNION ALL SELECT record_id, topic_id, label, retries, prompt_sha256 FROM topic_labels""",
}
