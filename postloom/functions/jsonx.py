"""Functions on nested and JSON values, rendering of prompts, and hooks for outside models.

Values that Spark's expressions can't reach (normalisation forms, canonical JSON, paths of any depth) go through Arrow
batches, once per distinct value. Null gives null.
"""

from __future__ import annotations

import hashlib
import json
import time
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _distinct(f: Callable, kind: str, col: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        done = [f(v) for v in values]
        return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return F.pandas_udf(run, kind)(col)


def nfkc(col: Column | str) -> Column:
    """Compatibility normalisation in composed form; plain ASCII is passed through."""
    return _distinct(lambda v: v if v.isascii() else unicodedata.normalize("NFKC", v), "string", col)


def _canonical_hash(text: str, drop: tuple[str, ...]) -> str | None:
    try:
        v = json.loads(text)
    except ValueError:
        return None
    if isinstance(v, dict):
        for k in drop:
            if k in v:
                v[f"{k}_sha256"] = hashlib.sha256(json.dumps(v.pop(k), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return json.dumps(v, sort_keys=True, ensure_ascii=False)


def hash_fields(col: Column | str, fields: list[str]) -> Column:
    """JSON objects with the named fields replaced by the hash of their canonical form; unreadable text gives null."""
    drop = tuple(fields)
    return _distinct(lambda v: _canonical_hash(v, drop), "string", col)


def _redact(v, path: list[str], tag: str):
    if not path:
        return tag if v is not None else None
    head, rest = path[0], path[1:]
    if isinstance(v, dict):
        keys = list(v) if head == "*" else [head] if head in v else []
        return {k: _redact(x, rest, tag) if k in keys else x for k, x in v.items()}
    if isinstance(v, list):
        return [_redact(x, rest if head == "*" else path, tag) for x in v]
    return v


def redact_paths(col: Column | str, paths: list[str], tag: str = "[REDACTED]") -> Column:
    """JSON with the values at dotted paths (``*`` for any key or element) replaced by a tag."""
    split = [p.split(".") for p in paths]

    def one(text: str) -> str | None:
        try:
            v = json.loads(text)
        except ValueError:
            return None
        for p in split:
            v = _redact(v, p, tag)
        return json.dumps(v, ensure_ascii=False)

    return _distinct(one, "string", col)


def numbered(items: Column) -> Column:
    """An array of texts as a numbered list, one per line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def render(template: str, **parts: Column) -> Column:
    """A template with each [NAME] replaced by the part of that name; null parts become empty."""
    out = F.lit(template)
    for name, col in parts.items():
        out = F.replace(out, F.lit(f"[{name.upper()}]"), F.coalesce(col, F.lit("")))
    return out


def leak_count(col: Column, allowed: list[str], patterns: list[str]) -> Column:
    """How many patterns still hit a text once the allowed phrases are masked."""
    masked = col
    for a in sorted(allowed, key=lambda x: (-len(x), x)):
        masked = F.replace(masked, F.lit(a), F.lit(" "))
    return F.array_size(F.array_compact(F.array(*[F.when(masked.rlike(p), F.lit(1)) for p in patterns]))) if patterns else F.lit(0)


def strip_entry_prefix(col: Column) -> Column:
    """Without an import prefix such as Entry0123."""
    return F.regexp_replace(col, r"(?i)^Entry\s*\d+\s*[:\-–—]?\s*", "")


def ago(epoch: Column, now: Column) -> Column:
    """An instant as a short relative text."""
    s = now - epoch
    unit = lambda n, letter: F.concat(F.floor(s / n).cast("string"), F.lit(letter))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).when(s < 604800, unit(86400, "d")).when(s.isNotNull(), unit(604800, "w"))


def with_client(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]], out: str, kind: T.DataType, batch: int = 32) -> DataFrame:
    """df with ``out``: what an outside model says of ``column``. ``make`` builds the client once per task (encoder, tagger,
    remote scorer, or a replay of recorded answers); it gets lists of values and gives as many answers."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            values = b[column].tolist()
            answers = [a for i in range(0, len(values), batch) for a in client(values[i : i + batch])]
            yield b.assign(**{out: answers})

    return df.mapInPandas(run, schema)


def grid_search(configs: list[dict], score: Callable[[dict], dict], floor: int) -> dict:
    """The configuration of greatest score among those with at least ``floor`` clusters, else of all; ties to the first.

    ``score`` runs one configuration (a Spark job) and gives ``score`` and ``n_clusters``.
    """
    tried = [{**c, **score(c)} for c in configs]
    if not tried:
        raise ValueError("no configurations")
    enough = [t for t in tried if t["n_clusters"] >= floor] or tried
    return max(enough, key=lambda t: t["score"])


class Resilient:
    """A client that tries again: up to ``tries`` calls with growing pauses, no more than ``per_minute`` a minute, and none
    at all for ``rest`` calls after ``breaker`` batches in a row have failed. A batch that fails for good gives nulls, which
    mark its rows for the retry queue."""

    def __init__(self, client: Callable[[list], list], tries: int = 3, pause: float = 1.0, per_minute: float | None = None, breaker: int = 5, rest: int = 10, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.client, self.tries, self.pause, self.breaker, self.rest, self.sleep, self.clock = client, tries, pause, breaker, rest, sleep, clock
        self.gap = 60 / per_minute if per_minute else 0.0
        self.failed = self.resting = 0
        self.last: float | None = None

    def _call(self, values: list) -> list | None:
        for k in range(self.tries):
            if self.gap and self.last is not None:
                self.sleep(max(0.0, self.last + self.gap - self.clock()))
            self.last = self.clock()
            try:
                got = self.client(values)
                if len(got) == len(values):
                    return got
            except Exception:  # whatever an outside service throws
                pass
            if k + 1 < self.tries:
                self.sleep(self.pause * 2**k)
        return None

    def __call__(self, values: list) -> list:
        if self.resting:
            self.resting -= 1
            return [None] * len(values)
        got = self._call(values)
        self.failed = 0 if got is not None else self.failed + 1
        if self.failed >= self.breaker:
            self.failed, self.resting = 0, self.rest
        return [None] * len(values) if got is None else got
