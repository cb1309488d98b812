"""Nested, irregular records to related flat tables.

Two halves share one table model. ``infer_merged_schema`` + ``conform`` turn JSON texts whose shape differs from record to
record into one typed column; ``flatten_records`` takes any nested column (from JSON or from Parquet) apart into a
root table and one child table per array or map level. Every row carries a surrogate key ``_id``; child rows also
``_parent_id``, ``_root_id`` and ``_ord``, the 1-based place in the parent (null elements are counted and kept).

Defined results for odd input: null or unreadable JSON gives no records (``without_records`` lists such rows); text around a JSON value is passed over; an empty array or
map gives no child rows; a null element gives a child row whose fields are all null; an empty table gives empty tables;
field names that clash after flattening get a numbered suffix; exact repeats of a record are kept as separate records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Objects all of whose keys look like data (numbers, months, dates) are maps, not records.
DATA_KEY = r"\d+|\d{4}-\d{2}(-\d{2})?"
_DATA_KEY = re.compile(DATA_KEY)
_NUMBER = re.compile(r"\s*[+-]?\d{1,18}\s*")

# A schema tree is {"kinds": set of scalar kinds, "fields": {...} | None, "items": tree | None, "map": tree | None}.


def _tree() -> dict:
    return {"kinds": [], "fields": None, "items": None, "map": None}


def _embedded(text: str):
    """The object or array that a string holds as JSON, else None."""
    s = text.strip()
    if s[:1] in "{[" and s[-1:] in "}]":
        try:
            v = json.loads(s)
        except ValueError:
            return None
        return v if isinstance(v, (dict, list)) else None
    return None


def _observe(v, tree: dict) -> None:
    if isinstance(v, str) and (inner := _embedded(v)) is not None:
        v = inner
    if isinstance(v, dict):
        if v and all(_DATA_KEY.fullmatch(k) for k in v):
            tree["map"] = tree["map"] or _tree()
            for x in v.values():
                _observe(x, tree["map"])
        else:
            tree["fields"] = {} if tree["fields"] is None else tree["fields"]
            for k, x in v.items():
                _observe(x, tree["fields"].setdefault(k, _tree()))
    elif isinstance(v, list):
        tree["items"] = tree["items"] or _tree()
        for x in v:
            _observe(x, tree["items"])
    else:
        kind = (
            "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int)
            else "float" if isinstance(v, float) else "numeric" if _NUMBER.fullmatch(v) else "text"
        )
        if kind not in tree["kinds"]:
            tree["kinds"].append(kind)


def merge_trees(a: dict | None, b: dict | None) -> dict | None:
    """The schema tree that holds all that either tree holds."""
    if a is None or b is None:
        return a or b
    fields = None
    if a["fields"] is not None or b["fields"] is not None:
        left, right = a["fields"] or {}, b["fields"] or {}
        fields = {k: merge_trees(left.get(k), right.get(k)) for k in [*left, *(k for k in right if k not in left)]}
    return {
        "kinds": sorted({*a["kinds"], *b["kinds"]}),
        "fields": fields,
        "items": merge_trees(a["items"], b["items"]),
        "map": merge_trees(a["map"], b["map"]),
    }


def _is_entry(tree: dict | None) -> bool:
    """Array elements of one key-like and one counted field are the entries of a map."""
    return bool(tree and tree["fields"] and len(tree["fields"]) == 2 and not tree["items"] and not tree["map"]) and all(
        f["fields"] is None and f["items"] is None for f in tree["fields"].values()
    )


def resolve(tree: dict) -> dict:
    """One shape per place: single objects and keyed objects beside arrays become arrays, entry lists beside maps maps."""
    t = dict(tree)
    if t["map"] is not None and t["items"] is not None and _is_entry(t["items"]) and t["map"]["fields"] is None:
        value = next((f for f in reversed(list(t["items"]["fields"].values()))), _tree())
        return {"shape": "map", "value": resolve(merge_trees(t["map"], value))}
    if t["items"] is not None or (t["map"] is not None and (t["fields"] is not None or t["map"]["fields"] is not None)):
        parts = merge_trees(merge_trees(t["items"], t["map"]), None if t["fields"] is None else {**_tree(), "fields": t["fields"]})
        return {"shape": "array", "item": resolve(parts)}
    if t["map"] is not None:
        return {"shape": "map", "value": resolve(t["map"])}
    if t["fields"] is not None:
        return {"shape": "struct", "fields": {k: resolve(v) for k, v in t["fields"].items()}}
    kinds = set(t["kinds"]) - {"null"}
    if kinds <= {"int", "numeric"} and kinds:
        return {"shape": "scalar", "type": "bigint"}
    if kinds <= {"int", "numeric", "float"} and kinds:
        return {"shape": "scalar", "type": "double"}
    return {"shape": "scalar", "type": "boolean" if kinds == {"bool"} else "string"}


def spark_type(shape: dict) -> T.DataType:
    if shape["shape"] == "struct":
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in shape["fields"].items()])
    if shape["shape"] == "array":
        return T.ArrayType(spark_type(shape["item"]))
    if shape["shape"] == "map":
        return T.MapType(T.StringType(), spark_type(shape["value"]))
    return {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[shape["type"]]


def find_records(v, anchor: str, context: dict | None = None, path: str = "") -> Iterator[dict]:
    """The outermost objects that have the field ``anchor``, in document order, each with the scalars around it."""
    context = context or {}
    if isinstance(v, str) and (inner := _embedded(v)) is not None:
        v = inner
    if isinstance(v, dict):
        if anchor in v:
            yield {"record": v, "context": context}
            return
        here = dict(context)
        nested = []
        for k, x in v.items():
            if isinstance(x, (dict, list)) or isinstance(x, str) and _embedded(x) is not None:
                nested.append((k, x))
            else:
                here[f"{path}{k}"] = x
        for k, x in list(nested):  # objects without records are context, too
            if isinstance(x, dict) and not any(True for _ in find_records(x, anchor)):
                here |= {f"{path}{k}.{n}": y for n, y in x.items() if not isinstance(y, (dict, list))}
        for k, x in nested:
            yield from find_records(x, anchor, here, f"{path}{k}.")
    elif isinstance(v, list):
        for x in v:
            yield from find_records(x, anchor, context, path)


_DECODER = json.JSONDecoder()


def _loads(text):
    """The JSON value of a text; of a text with something around it, the first object or array in it; else None."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    for m in re.finditer(r"[\[{]", text):
        try:
            return _DECODER.raw_decode(text, m.start())[0]
        except (ValueError, RecursionError):
            continue
    return None


def infer_merged_schema(df: DataFrame, json_col: str, anchor: str, buckets: int = 64) -> dict:
    """The merged schema tree of all records in a column of JSON texts, over all rows.

    Each partition merges its own records into one tree; trees are merged in ``buckets`` groups and then on the driver,
    so what reaches the driver is bounded by buckets times the size of the schema, whatever the number of rows.
    """

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, n = None, 0
        for b in batches:
            for text in b["j"]:
                for r in find_records(_loads(text), anchor):
                    tree = tree or _tree()
                    _observe(r["record"], tree)
                    n += 1
        if tree is not None:
            yield pd.DataFrame({"tree": [json.dumps(tree)]})

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        tree = None
        for t in b["tree"]:
            tree = merge_trees(tree, json.loads(t))
        return pd.DataFrame({"tree": [json.dumps(tree)]})

    # Equal trees, the normal case, are one row before they meet.
    parts = df.select(F.col(json_col).alias("j")).mapInPandas(observe, "tree string").distinct().withColumn("bucket", F.pmod(F.xxhash64("tree"), F.lit(buckets)))
    tree = None
    for row in parts.groupBy("bucket").applyInPandas(merge, "tree string").toLocalIterator():
        tree = merge_trees(tree, json.loads(row["tree"]))
    return resolve(tree or {**_tree(), "fields": {anchor: _tree()}})


def _conform(v, shape: dict):
    if isinstance(v, str) and shape["shape"] != "scalar":
        v = _embedded(v)
    if v is None:
        return None
    if shape["shape"] == "struct":
        return {k: _conform(v.get(k), s) for k, s in shape["fields"].items()} if isinstance(v, dict) else None
    if shape["shape"] == "array":
        if isinstance(v, dict):
            keyed = all(_DATA_KEY.fullmatch(k) for k in v)  # also an empty object, which has no elements
            v = [v[k] for k in sorted(v, key=lambda k: (len(k), k))] if keyed else [v]
        if not isinstance(v, list):
            v = [v]
        return [_conform(x, shape["item"]) for x in v]
    if shape["shape"] == "map":
        if isinstance(v, list):
            pairs = [tuple(x.values()) for x in v if isinstance(x, dict) and len(x) == 2]
            v = {str(a if _DATA_KEY.fullmatch(str(a)) else b): (b if _DATA_KEY.fullmatch(str(a)) else a) for a, b in pairs}
        return {k: _conform(x, shape["value"]) for k, x in v.items()} if isinstance(v, dict) else None
    if isinstance(v, (dict, list)):
        return json.dumps(v)
    if shape["type"] == "string":
        return v if isinstance(v, str) else json.dumps(v)
    if isinstance(v, str):
        return _loads(v.strip().lstrip("+")) if _NUMBER.fullmatch(v) else None
    return v


def conform(df: DataFrame, json_col: str, keys: list[str], anchor: str, shape: dict) -> DataFrame:
    """One row per record of the texts: ``keys``, ``_record_no`` (1-based in its text), ``context`` map, ``record`` typed.

    JSON is parsed and brought to the merged shape in Arrow batches; the typed column is then built in the JVM.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {**{k: [] for k in keys}, "_record_no": [], "_context": [], "_record": []}
            for *key, text in b[[*keys, json_col]].itertuples(index=False, name=None):
                for n, r in enumerate(find_records(_loads(text), anchor), 1):
                    for k, x in zip(keys, key):
                        out[k].append(x)
                    out["_record_no"].append(n)
                    out["_context"].append(json.dumps({k: None if x is None else str(x) for k, x in r["context"].items()}))
                    out["_record"].append(json.dumps(_conform(r["record"], shape)))
            if out["_record"]:
                yield pd.DataFrame(out)

    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("_record_no", T.LongType()), T.StructField("_context", T.StringType()), T.StructField("_record", T.StringType())])
    flat = df.select(*keys, json_col).mapInPandas(run, schema)
    return flat.select(
        *keys, "_record_no",
        F.from_json("_context", "map<string,string>").alias("context"),
        F.from_json("_record", spark_type(shape)).alias("record"),
    )


def without_records(df: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose text gave no record."""
    return df.join(records.select(*keys).distinct(), keys, "left_anti")


def _leaves(col: Column, kind: T.DataType, name: str) -> tuple[list[tuple[str, Column]], list[tuple[str, Column, T.DataType]]]:
    """The scalar columns under col, structs opened, and the arrays and maps under it."""
    flat, nested = [], []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            a, b = _leaves(col[f.name], f.dataType, f"{name}__{f.name}" if name else f.name)
            flat += a
            nested += b
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        nested.append((name, col, kind))
    else:
        flat.append((name or "value", col))
    return flat, nested


def _unique(named: list[tuple[str, Column]], taken: set[str]) -> list[Column]:
    out = []
    for name, col in named:
        n, free = 1, name
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out.append(col.alias(free))
    return out


def flatten_records(df: DataFrame, root: str, keys: list[str], carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A nested table as flat tables: ``root`` and one table per array or map level, named by its path.

    ``keys`` identify a row of df and stand in every table, as do the scalars of a row named by ``carry``. ``_id`` is made of keys and ordinals, so that it is the same
    when a lost task is run again. Structs are opened in place. Only narrow explodes are used: no shuffle at any level.
    """
    for k in (*keys, *carry):
        if k not in df.columns:
            raise ValueError(f"no column {k}")
    ident = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    keys = [*keys, *carry]
    others = T.StructType([f for f in df.schema.fields if f.name not in keys])
    tables: dict[str, DataFrame] = {}

    def emit(name: str, frame: DataFrame, head: list[str], flat: list, nested: list) -> None:
        tables[name] = frame.select(*head, *_unique(flat, {h.lower() for h in head}))
        for path, col, kind in nested:
            base = frame.select(*keys, F.col("_id").alias("_parent_id"), F.col("_root_id") if "_root_id" in frame.columns else F.col("_id").alias("_root_id"), col.alias("_nest"))
            if isinstance(kind, T.MapType):
                entries = F.array_sort(F.map_entries("_nest"))
                sub = base.select("*", F.posexplode(entries).alias("_pos", "_e")).select(*keys, "_parent_id", "_root_id", (F.col("_pos") + 1).alias("_ord"), F.col("_e.key").alias("_key"), F.col("_e.value").alias("_item"))
                element, extra = kind.valueType, ["_key"]
            else:
                sub = base.select(*keys, "_parent_id", "_root_id", F.posexplode("_nest").alias("_pos", "_item")).select(*keys, "_parent_id", "_root_id", (F.col("_pos") + 1).alias("_ord"), "_item")
                element, extra = kind.elementType, []
            child = f"{name}.{path}" if path else f"{name}.item"
            sub = sub.withColumn("_id", F.concat_ws("/", "_parent_id", F.concat(F.lit(path + "["), F.col("_ord").cast("string"), F.lit("]"))))
            a, b = _leaves(F.col("_item"), element, "")
            emit(child, sub, [*keys, "_id", "_parent_id", "_root_id", "_ord", *extra], a, b)

    frame = df.withColumn("_id", ident)
    flat, nested = [], []
    for f in others.fields:
        a, b = _leaves(F.col(f"`{f.name}`"), f.dataType, f.name)
        flat += a
        nested += b
    emit(root, frame, [*keys, "_id"], flat, nested)
    return tables

