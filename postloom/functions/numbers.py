"""Numeric functions as columns. Dirty input never fails: what is no number counts as said in each function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_count(col: Column) -> Column:
    """A count given as number or text: 1.2K, 2M, numeric text cut to whole; null, negative, endless or other text is 0."""
    s = F.trim(col.cast("string"))
    scaled = r"^([0-9]*\.?[0-9]+)\s*([KkMm])$"
    unit = F.when(F.upper(F.regexp_extract(s, scaled, 2)) == "K", 1_000.0).otherwise(1_000_000.0)
    short = F.round(F.nullif(F.regexp_extract(s, scaled, 1), F.lit("")).cast("double") * unit)
    plain = F.when(s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?$"), s.try_cast("double"))
    n = F.when(s.rlike(scaled), short).when(F.lower(s) == "true", F.lit(1.0)).otherwise(plain)
    return F.when(F.abs(n) < 9e18, F.greatest(F.lit(0), n.cast("bigint"))).otherwise(F.lit(0)).cast("bigint")


def scraped_count(col: Column) -> Column:
    """A count as shown on a page: thousands separators allowed, K and M cut to whole."""
    return as_count(F.regexp_replace(col.cast("string"), ",", ""))


def clamp(col: Column, low: int = 1, high: int = 9) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def clamp_flags(v: Column, a: Column, d: Column, sarcasm: Column, low: int = 1, high: int = 9) -> Column:
    """The flags of a score triple: range_clamped first, then which dimension was missing or clamped, then
    sarcasm_high_valence (sarcasm with a clamped valence of 7 or more)."""
    off = lambda c: ~c.between(low, high)
    any_off = reduce(lambda x, y: x | y, [F.coalesce(off(c), F.lit(True)) for c in (v, a, d)])
    flags = [F.when(any_off, F.lit("range_clamped"))]
    for name, c in (("v", v), ("a", a), ("d", d)):
        flags.append(F.when(c.isNull(), F.lit(f"{name}_missing")).when(off(c), F.lit(f"{name}_clamped")))
    flags.append(F.when(F.coalesce(sarcasm, F.lit(False)) & (F.coalesce(clamp(v, low, high), F.lit(low)) >= 7), F.lit("sarcasm_high_valence")))
    return F.array_compact(F.array(*flags))


def score_number(col: Column) -> Column:
    """A score as JSON text holds it: a bare number is cut to whole, a quoted one that isn't whole is rounded (half to even)."""
    quoted = col.rlike(r'^\s*".*"\s*$')
    n = F.regexp_replace(col, '"', "").try_cast("double")
    return F.when(quoted, F.bround(n)).otherwise(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))).cast("int")


def tone(v: Column) -> Column:
    """What sarcasm with this valence means."""
    return F.when(v <= 4, "negative").when(v >= 7, "ironic_praise").when(v.isNotNull(), "ambivalent")


def valence_band(v: Column) -> Column:
    return F.when(v <= 3, "low").when(v <= 6, "middle").when(v.isNotNull(), "high")


def quadrant(x: Column, y: Column, mid: float = 5.0) -> Column:
    """Which side of the middle both values lie, as two letters."""
    side = lambda c: F.when(c >= mid, "H").when(c.isNotNull(), "L")
    return F.concat(side(x), side(y))


def delta_direction(delta: Column, dead: float = 0.005, invert: bool = False) -> Column:
    up, down = ("worse", "better") if invert else ("better", "worse")
    return F.when(delta.isNull(), "none").when(F.abs(delta) < dead, "flat").when(delta > 0, up).otherwise(down)


def ring_index(col: Column, n: int) -> Column:
    """A place on a ring of n, also for negative numbers."""
    return F.pmod(col, F.lit(n))


def size_tier(n: Column, bounds: tuple[int, int] = (1500, 5000)) -> Column:
    return F.when(n < bounds[0], "small").when(n < bounds[1], "medium").when(n.isNotNull(), "large")


def upper_median(values: Column) -> Column:
    """Of an array, the element at half its length (rounded down) in order; null for an empty one."""
    s = F.array_sort(F.array_compact(values))
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def gini(counts: Column) -> Column:
    """The Gini coefficient of an array of counts: 0 where all are equal or there are none."""
    s = F.transform(F.array_sort(counts), lambda c: c.cast("double"))
    n = F.size(s).cast("double")
    total = F.aggregate(s, F.lit(0.0), lambda a, c: a + c)
    weighted = F.aggregate(F.transform(s, lambda c, i: c * (i + 1)), F.lit(0.0), lambda a, c: a + c)
    return F.when((n > 0) & (total > 0), 2 * weighted / (n * total) - (n + 1) / n).otherwise(F.lit(0.0))
