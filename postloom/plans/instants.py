"""One instant per post from its two stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.io import table
from postloom.operators.timestamps import one_instant, parse_stamps

STAMPS = ["timestamp_iso", "timestamp_raw"]


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with both parsed stamps, the instant and which stamp gave it; null where neither names one."""
    posts = table(spark, sf_dir, "golden_input", "row_id", "_test_source_code", *STAMPS)
    walls = table(spark, sf_dir, "source_ref", "source_code", "tz_name", "date_order")
    df = parse_stamps(posts.join(walls, posts._test_source_code == walls.source_code, "left"), STAMPS, "tz_name", "date_order")
    return df.select("row_id", *[f"{s}_{x}" for s in STAMPS for x in ("epoch", "unit")], one_instant(STAMPS).alias("epoch_s"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants(spark, sf_dir).where(F.col("epoch_s").isNotNull()).select("row_id", "epoch_s")


QUERIES = {"p6_found": found, "p6_instants": instants}
# The same in SQL, format by format: each pattern gives the parts of the local time, then the zone's shift is taken off.
_PLACES = """CASE lower(left({m}, 3)) WHEN 'jan' THEN 1 WHEN 'ene' THEN 1 WHEN 'feb' THEN 2 WHEN 'peb' THEN 2 WHEN 'mar' THEN 3 WHEN 'apr' THEN 4 WHEN 'abr' THEN 4 WHEN 'may' THEN 5 WHEN 'jun' THEN 6 WHEN 'hun' THEN 6
  WHEN 'jul' THEN 7 WHEN 'hul' THEN 7 WHEN 'aug' THEN 8 WHEN 'ago' THEN 8 WHEN 'sep' THEN 9 WHEN 'set' THEN 9 WHEN 'oct' THEN 10 WHEN 'okt' THEN 10 WHEN 'nov' THEN 11 WHEN 'nob' THEN 11 WHEN 'dec' THEN 12 WHEN 'dis' THEN 12 END"""
_CLOCK = "(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:\\.\\d+)?)?\\s*([AP]M)?\\s*(\\S*)$"
_FORMS = {  # pattern and the places of year, month, day; the clock's five groups follow them
    "^(\\d{4})-(\\d{2})-(\\d{2})[T ]" + _CLOCK: ("x[1]", "x[2]::INT", "x[3]"),
    "^(\\d{2})/(\\d{2})/(\\d{4}) " + _CLOCK: ("x[3]", "(CASE date_order WHEN 'dmy' THEN x[2] ELSE x[1] END)::INT", "(CASE date_order WHEN 'dmy' THEN x[1] ELSE x[2] END)"),
    "^([A-Z][a-z]+) (\\d{1,2}), (\\d{4}) " + _CLOCK: ("x[3]", _PLACES.format(m="x[1]"), "x[2]"),
    "^(?:[A-Z][a-z]{2}, |ika-)?(\\d{1,2}) (?:ng )?([A-Z][a-z]+) (\\d{4}),? (?:at )?" + _CLOCK: ("x[3]", _PLACES.format(m="x[2]"), "x[1]"),
}


def _parts() -> str:
    out = [
        "SELECT row_id, k, tz_name, left(x[1], 4) AS y, substr(x[1], 5, 2)::INT AS mo, substr(x[1], 7, 2) AS d, left(x[2], 2) AS h, substr(x[2], 3, 2) AS mi, nullif(substr(x[2], 5, 2), '') AS se, '' AS ap, x[3] AS z "
        "FROM (SELECT *, regexp_extract_all(s, '^(\\d{8})T(\\d{4,6})(\\S*)$', 0) AS hit, [regexp_extract(s, '^(\\d{8})T(\\d{4,6})(\\S*)$', 1), regexp_extract(s, '^(\\d{8})T(\\d{4,6})(\\S*)$', 2), regexp_extract(s, '^(\\d{8})T(\\d{4,6})(\\S*)$', 3)] AS x FROM t) WHERE len(hit) > 0"
    ]
    for pattern, (y, mo, d) in _FORMS.items():
        groups = ", ".join(f"regexp_extract(s, '{pattern}', {i})" for i in range(1, 9))
        out.append(f"SELECT row_id, k, tz_name, {y} AS y, {mo} AS mo, {d} AS d, x[4] AS h, x[5] AS mi, nullif(x[6], '') AS se, x[7] AS ap, x[8] AS z FROM (SELECT *, [{groups}] AS x FROM t WHERE regexp_matches(s, '{pattern}'))")
    return " UNION ALL ".join(out)


_FOUND_SQL = f"""
WITH t AS (SELECT row_id, 1 AS k, trim(timestamp_iso, ' ') AS s, tz_name, date_order FROM golden_input LEFT JOIN source_ref ON _test_source_code = source_code
  UNION ALL SELECT row_id, 2, trim(timestamp_raw, ' '), tz_name, date_order FROM golden_input LEFT JOIN source_ref ON _test_source_code = source_code),
epochs AS (SELECT row_id, k, CASE length(n) WHEN 10 THEN n::BIGINT WHEN 13 THEN n::BIGINT // 1000 ELSE n::BIGINT // 1000000 END AS e, true AS fine
  FROM (SELECT row_id, k, regexp_extract(s, '^(\\d{{10}}|\\d{{13}}|\\d{{16}})(\\.\\d+)?$', 1) AS n FROM t) WHERE n <> ''),
parts AS ({_parts()}),
local AS (SELECT row_id, k, tz_name, z, se, try_cast(y || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') || ' ' || lpad((CASE WHEN ap = '' THEN h::INT ELSE h::INT % 12 + CASE ap WHEN 'PM' THEN 12 ELSE 0 END END)::VARCHAR, 2, '0') || ':' || mi || ':' || coalesce(se, '00') AS TIMESTAMP) AS ts FROM parts),
zoned AS (SELECT *, CASE WHEN z = '' THEN tz_name WHEN contains(z, '/') THEN z END AS named, regexp_extract(z, '^(?:UTC|GMT)?([+-])(\\d{{1,2}}):?(\\d{{2}})?$', 2) AS hh, regexp_extract(z, '^(?:UTC|GMT)?([+-])(\\d{{1,2}}):?(\\d{{2}})?$', 3) AS mm FROM local WHERE ts IS NOT NULL),
stamps AS (SELECT row_id, k, CASE WHEN named IS NOT NULL THEN least(epoch(timezone(named, ts)), epoch(timezone(named, ts - INTERVAL 1 HOUR)) + 3600)::BIGINT
    WHEN hh <> '' THEN epoch(ts)::BIGINT - CASE WHEN contains(z, '-') THEN -1 ELSE 1 END * (hh::INT * 3600 + coalesce(nullif(mm, '')::INT, 0) * 60)
    ELSE epoch(ts)::BIGINT - 3600 * CASE z WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'PHT' THEN 8 WHEN 'PHST' THEN 8 WHEN 'HKT' THEN 8 WHEN 'SGT' THEN 8 WHEN 'JST' THEN 9 WHEN 'AEST' THEN 10 WHEN 'AEDT' THEN 11
      WHEN 'CET' THEN 1 WHEN 'CEST' THEN 2 WHEN 'EST' THEN -5 WHEN 'EDT' THEN -4 END END AS e, se IS NOT NULL AS fine FROM zoned)
SELECT row_id, e AS epoch_s FROM (SELECT * FROM epochs UNION ALL SELECT * FROM stamps) WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY fine DESC, k) = 1"""
SQL: dict[str, str] = {"p6_found": _FOUND_SQL}
