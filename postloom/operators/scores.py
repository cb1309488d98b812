"""Model-made scores: parsing what came back, checking it and measuring agreement.

Defined results: unreadable text gives null (no records); one bad record makes its whole answer invalid; of repeated
answers the last counts; empty tables give empty results or zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.numbers import clamp, clamp_flags

RECORD = "struct<id:string,post_id:string,V:string,A:string,D:string,sarcasm:string>"


def repaired(text: Column) -> Column:
    """The first list or object of a text, mended where models break it: quotes of other kinds, bare keys, words of truth,
    commas before an end, ends that are missing. Null where there is none."""
    t = F.nullif(F.regexp_extract(text, r"(?s)(\[.*|\{.*)", 1), F.lit(""))
    t = F.regexp_replace(t, r"(?s)^(\[.*\]|\{.*\})[^\]}]*$", "$1")  # nothing behind the last end
    for pattern, to in (
        ("[\u201c\u201d]", '"'), (r"(?<=[\[{,:]\s{0,4})'|'(?=\s*[,:}\]])", '"'), (r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":'),
        (r":\s*True\b", ": true"), (r":\s*False\b", ": false"), (r":\s*None\b", ": null"), (r",(\s*[}\]])", "$1"), (r",\s*$", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    lacks = lambda a, b: F.greatest(F.regexp_count(t, F.lit(a)) - F.regexp_count(t, F.lit(b)), F.lit(0))
    return F.concat(t, F.repeat(F.lit("}"), lacks(r"\{", r"\}")), F.repeat(F.lit("]"), lacks(r"\[", r"\]")))


def parse_answer(text: Column, repair: bool = False) -> Column:
    """The score records of an answer: the whole text as JSON, else its first bracketed list, else a single object, else (if
    asked for) what a repair makes of it; null where none of them is readable or any record lacks its id or a number. Truth
    values are no numbers."""
    array = f"array<{RECORD}>"
    t = F.trim(text)
    whole = F.when(t.startswith("["), F.from_json(t, array))
    one = F.when(t.startswith("{"), F.array(F.from_json(t, RECORD)))
    inside = F.from_json(F.nullif(F.regexp_extract(t, r"(?s)\[.*?\]", 0), F.lit("")), array)
    readable = lambda rs: F.when((F.size(rs) > 0) & F.forall(rs, lambda r: F.coalesce(r["id"], r["post_id"]).isNotNull()), rs)
    found = F.coalesce(F.when(F.size(whole) >= 0, whole), one, inside)
    if repair:
        r = repaired(t)
        found = F.coalesce(readable(found), F.when(r.startswith("["), F.from_json(r, array)), F.when(r.startswith("{"), F.array(F.from_json(r, RECORD))))
    number = lambda c: c.try_cast("double")
    truth = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("false")))).isin("true", "1", "yes", "y")
    whole_score = lambda c: F.when(number(c) >= 0, F.floor(number(c))).otherwise(F.ceil(number(c))).cast("int")
    typed = F.transform(
        found,
        lambda r: F.struct(
            F.coalesce(r["id"], r["post_id"]).alias("id"), whole_score(r["V"]).alias("v"), whole_score(r["A"]).alias("a"), whole_score(r["D"]).alias("d"), truth(r["sarcasm"]).alias("sarcasm")
        ),
    )
    good = F.forall(typed, lambda r: r["id"].isNotNull() & r["v"].isNotNull() & r["a"].isNotNull() & r["d"].isNotNull())
    return F.when(good, typed)


def checked(df: DataFrame) -> DataFrame:
    """v, a, d brought into their range and the flags of the check put before the row's own."""
    flags = F.concat(clamp_flags(F.col("v"), F.col("a"), F.col("d"), F.col("sarcasm")), F.coalesce("flags", F.array().cast("array<string>")))
    return df.withColumn("flags", flags).withColumns({c: F.coalesce(clamp(F.col(c)), F.lit(1)) for c in ("v", "a", "d")})


def agreement(df: DataFrame, pairs: dict[str, tuple[str, str]], truth: tuple[str, str]) -> DataFrame:
    """One row: per pair of columns the part within one step and Pearson's r, the joint part, and Cohen's kappa of two truth columns."""
    near = {k: F.abs(F.col(a) - F.col(b)) <= 1 for k, (a, b) in pairs.items()}
    joint = None
    for n in near.values():
        joint = n if joint is None else joint & n
    p, q = F.col(truth[0]).cast("int"), F.col(truth[1]).cast("int")
    aggs = [F.count("*").alias("n")]
    for k, (a, b) in pairs.items():
        aggs += [F.avg(near[k].cast("int")).alias(f"{k}_within_1"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{k}_pearson")]
    aggs += [F.avg(joint.cast("int")).alias("joint_within_1"), F.avg((p == q).cast("int")).alias("_po"), F.avg(p).alias("_p"), F.avg(q).alias("_q")]
    r = df.agg(*aggs)
    pe = F.col("_p") * F.col("_q") + (1 - F.col("_p")) * (1 - F.col("_q"))
    return r.withColumn("kappa", F.when(pe < 1, (F.col("_po") - pe) / (1 - pe))).drop("_po", "_p", "_q")


def largest_first(jobs: list[tuple[str, float]], bins: int) -> list[tuple[str, int, float]]:
    """Jobs given to the least loaded bin, the largest first, ties to the lower bin: (job, bin, load of the bin after it).

    A plan for a handful of partitions; runs on the driver.
    """
    load = [0.0] * bins
    out = []
    for name, size in sorted(jobs, key=lambda j: (-j[1], j[0])):
        b = min(range(bins), key=lambda i: (load[i], i))
        load[b] += size
        out.append((name, b, load[b]))
    return out
