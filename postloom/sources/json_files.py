"""JSON and text sources.

Schemas are given, never inferred. Malformed lines fail the read, are dropped or are kept beside the good rows, as asked.
Blank lines never count. A missing or empty folder gives an empty table where the reader is told so.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.functions.text import strip

POST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("post_id", "text", "timestamp_iso", "timestamp_raw", "post_url", "source")]
    + [T.StructField("engagement", T.StructType([T.StructField(c, T.StringType()) for c in ("reactions", "comments", "shares")]))]
)
MODES = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, malformed: str = "fail") -> DataFrame:
    """One record per line. malformed: fail, drop, or keep (the line in ``_malformed``, null for good rows)."""
    if malformed == "keep":
        return spark.read.schema(schema.add("_malformed", T.StringType())).option("columnNameOfCorruptRecord", "_malformed").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", MODES[malformed]).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array (or object) each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_by_source(spark: SparkSession, folder: str, schema: T.StructType, known: DataFrame | None = None, malformed: str = "drop") -> DataFrame:
    """All ``<code>.jsonl`` files of a folder with ``source_code`` from the file name; files of unknown codes are left out,
    with a warning that names them. Malformed lines are dropped, fail the read or are kept, as ``malformed`` asks."""
    df = read_jsonl(spark, f"{folder}/*.jsonl", schema, malformed).withColumn("source_code", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))
    if known is None:
        return df
    codes = known.select("source_code").distinct()
    unknown = [r.source_code for r in df.select("source_code").distinct().join(codes, "source_code", "left_anti").limit(100).toLocalIterator()]
    if unknown:
        warnings.warn(f"files of unknown sources are left out: {', '.join(sorted(unknown))}", stacklevel=2)
    return df.join(codes, "source_code", "left_semi")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines of text files without blank ones and comments (#)."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> '' AND value NOT LIKE '#%'")


def read_yaml_table(spark: SparkSession, path: str, schema: str, overlay: str | None = None, key: str | None = None) -> DataFrame:
    """A small YAML list of records as a table; records of an overlay file replace those with the same key."""
    import yaml

    rows = yaml.safe_load(Path(path).read_text()) or []
    if overlay and Path(overlay).exists():
        over = {r[key]: r for r in yaml.safe_load(Path(overlay).read_text()) or []}
        rows = [{**r, **over.pop(r[key], {})} for r in rows] + list(over.values())
    fields = T.StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def json_bodies(body: Column) -> Column:
    """The JSON values of a response body, as texts: each line that is JSON where the first line is, else the whole body."""
    # The parser takes a value that other text follows; so a line counts only if it also ends like a value.
    complete = lambda x: F.trim(x).rlike(r"(?s)^[\[{].*[\]}]$") & F.try_parse_json(x).isNotNull()
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    by_line = F.when((F.size(lines) > 1) & complete(F.get(lines, F.lit(0))), F.filter(lines, complete))
    return F.coalesce(by_line, F.when(complete(body), F.array(body)), F.array().cast("array<string>"))


def first_of(*columns: str) -> Column:
    """The first of several fields that is neither null nor empty (aliases of one field)."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def _walk(v, path: str = "$") -> Iterator[tuple[str, object]]:
    stack = [(path, v)]
    while stack:
        p, x = stack.pop()
        yield p, x
        if isinstance(x, dict):
            stack += [(f"{p}.{k}", y) for k, y in reversed(list(x.items()))]
        elif isinstance(x, list):
            stack += [(f"{p}[{i}]", y) for i, y in reversed(list(enumerate(x)))]


def find_objects(df: DataFrame, id_col: str, body: str, keys: list[str]) -> DataFrame:
    """id, path and object (as JSON) of every object at any depth that has all of ``keys``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b[id_col], b[body], strict=True):
                try:
                    v = json.loads(text) if isinstance(text, str) else None
                except ValueError:
                    continue
                rows += [(i, p, json.dumps(x)) for p, x in _walk(v) if isinstance(x, dict) and all(k in x for k in keys)]
            if rows:
                yield pd.DataFrame(rows, columns=[id_col, "path", "object"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, body).mapInPandas(run, f"{id_col} {kind}, path string, object string")


def key_paths(df: DataFrame, body: str) -> DataFrame:
    """Every key path of the bodies (array places as []) and how many values stand there, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        n: dict[str, int] = {}
        for b in batches:
            for text in b[body]:
                try:
                    v = json.loads(text) if isinstance(text, str) else None
                except ValueError:
                    continue
                for p, _ in _walk(v):
                    p = re.sub(r"\[\d+\]", "[]", p)
                    n[p] = n.get(p, 0) + 1
        if n:
            yield pd.DataFrame(list(n.items()), columns=["path", "n"])

    return df.select(body).mapInPandas(run, "path string, n long").groupBy("path").agg(F.sum("n").alias("n"))


def largest_fallback(candidates: dict[str, DataFrame], target: int) -> tuple[str, DataFrame]:
    """Of several ways to the same rows, in order: the first that brings ``target`` rows, else the one with most."""
    best: tuple[int, str, DataFrame] | None = None
    for name, df in candidates.items():
        n = df.limit(target).count()
        if best is None or n > best[0]:
            best = (n, name, df)
        if n >= target:
            break
    if best is None:
        raise ValueError("no candidates")
    return best[1], best[2]
