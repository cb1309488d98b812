"""Mixing sources to target weights.

Each task turns its documents into tokens of a public tokenizer and packs the tokens of each source into blocks of fixed
length, in one pass over the texts; blocks are then numbered per source. Each output shard draws how many of its slots each
source fills: a multinomial draw given the planned totals, made by halving the range of shards again and again, so that any
shard's counts, and how many slots of each source lie before it, follow from the seed alone. The slots of a source go
through pseudorandom permutations of the source's block numbers, one permutation per repetition; slots and blocks are then
joined by source and block number. Nothing grows on the driver but the table of sources.

Targets: a source without documents cannot be reached and a source at its cap (tokens x max_repeats) is filled to the
cap; what is left over goes to the other sources in proportion to their targets, so that the total is kept where the caps
allow it. Sources without a target take no part. ``shares`` reports target and actual shares for all of them.

Defined results: null and empty texts have no tokens and appear in no block; each task's last block of a source is shorter and kept
whole; repeated documents are documents of their own; empty tables give empty results; very long documents span blocks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postloom.session import materialise

TOKENIZERS = "/opt/tokenizers"
BLOCK_TOKENS = 1024
SHARD_BLOCKS = 256
SPAN = 1024  # tasks numbered together


def default_tokenizer(spark: SparkSession) -> str:
    """The tokenizer file: in the folder that the session names in ``spark.postloom.tokenizers``, else in TOKENIZERS."""
    return f"{spark.conf.get('spark.postloom.tokenizers', TOKENIZERS)}/byte_bpe_50k.json"


def _encoder(tokenizer: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND text <> '' AND source IS NOT NULL").select("source", "text")


def token_blocks(docs: DataFrame, tokenizer: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """source, part (the task), k (0-based in its task), n_tokens and tokens of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part = _encoder(tokenizer), TaskContext.get().partitionId()
        held: dict[str, list[int]] = {}
        made: dict[str, int] = {}
        out: list[tuple] = []

        def emit(source: str, tokens: list[int]) -> None:
            out.append((source, part, made.get(source, 0), len(tokens), tokens))
            made[source] = made.get(source, 0) + 1

        def frame() -> pd.DataFrame:
            got = pd.DataFrame(out, columns=["source", "part", "k", "n_tokens", "tokens"])
            out.clear()
            return got

        for b in batches:
            for i in range(0, len(b), 64):
                for source, ids in zip(b["source"].iloc[i : i + 64], encode(b["text"].iloc[i : i + 64].tolist()), strict=True):
                    have = held.setdefault(source, [])
                    have += ids
                    if len(have) >= block:
                        full = len(have) // block * block
                        for at in range(0, full, block):
                            emit(source, have[at : at + block])
                        del have[:full]
                if len(out) >= 512:
                    yield frame()
        for source, have in held.items():
            if have:
                emit(source, have)
        if out:
            yield frame()

    return _texts(docs).mapInPandas(run, "source string, part int, k long, n_tokens int, tokens array<int>")


def _before(df: DataFrame, group: list[str], order: str, value: str) -> Column:
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def numbered_blocks(docs: DataFrame, tokenizer: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """source, block_no (0-based, without gaps per source), n_tokens and tokens of every block.

    Texts are read and tokenised once and the blocks written once. Only the numbers of blocks of each task are summed:
    inside spans of SPAN tasks, and over the spans.
    """
    blocks = materialise(token_blocks(docs, tokenizer, block), "blocks")
    per = blocks.groupBy("source", "part").agg(F.count("*").alias("c")).withColumn("span", F.floor(F.col("part") / SPAN))
    spans = per.groupBy("source", "span").agg(F.sum("c").alias("c"))
    spans = spans.select("source", "span", _before(spans, ["source"], "span", "c").alias("start"))
    base = per.withColumn("inner", _before(per, ["source", "span"], "part", "c")).join(spans, ["source", "span"])
    return blocks.join(base.select("source", "part", (F.col("start") + F.col("inner")).alias("base")), ["source", "part"]).select(
        "source", (F.col("base") + F.col("k")).alias("block_no"), "n_tokens", "tokens"
    )


def plan_totals(sources: list[dict], total: float | None) -> dict[str, float]:
    """Tokens to take of each source. sources: source, tokens, target (or None), cap (repeats)."""
    wanted = {s["source"]: s for s in sources if s["target"] and s["tokens"]}
    caps = {k: s["tokens"] * max(0, s["cap"]) for k, s in wanted.items()}
    left = float(sum(s["tokens"] for s in wanted.values()) if total is None else total)
    left = min(left, float(sum(caps.values())))
    take: dict[str, float] = {}
    open_ = dict(wanted)
    while open_:
        weight = sum(s["target"] for s in open_.values())
        full = [k for k, s in open_.items() if left * s["target"] / weight >= caps[k]]
        if not full:
            take |= {k: left * s["target"] / weight for k, s in open_.items()}
            break
        for k in full:
            take[k] = caps[k]
            left -= caps[k]
            del open_[k]
    return {k: max(0.0, v) for k, v in take.items()}


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each element a pseudorandom permutation, chosen by key, of 0..size-1, at index: a Feistel network with cycle walking."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(2, size)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    x = out.copy()
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x >> half, x & mask
            for r in range(4):
                f = (right + key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            x = np.where(todo, (left << half) | right, x)
            done = todo & (x < size.astype(np.uint64))
            out[done] = x[done]
            todo &= ~done
    return out.astype(np.int64)


def plan_slots(take: dict[str, float], facts: dict[str, tuple[int, int, int]]) -> dict[str, int]:
    """Slots of each source: its tokens over the mean tokens of its blocks, rounded by largest remainder, never above its cap."""
    need = {k: v / (facts[k][1] / facts[k][0]) for k, v in take.items() if v > 0}
    total = int(round(sum(need.values())))
    slots = {k: min(int(v), facts[k][0] * facts[k][2]) for k, v in need.items()}
    for k in sorted(need, key=lambda k: (slots[k] - need[k], k)):
        if sum(slots.values()) < total and slots[k] < facts[k][0] * facts[k][2]:
            slots[k] += 1
    return {k: v for k, v in slots.items() if v}


EXACT_DRAW = 10**9  # slots up to which numpy draws exactly


def halve(counts: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """How many of each source's slots fall on n of all slots, drawn without replacement."""
    r = np.random.default_rng(key)
    total = int(counts.sum())
    if total < EXACT_DRAW:
        return r.multivariate_hypergeometric(counts, n, method="marginals")
    # Beyond that the normal limit, brought back to whole numbers that add up.
    p = n / total
    x = np.clip(np.rint(counts * p + r.standard_normal(len(counts)) * np.sqrt(counts * p * (1 - p))), 0, counts).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        x[i] += np.clip(n - x.sum(), -x[i], counts[i] - x[i])
    return x


def draw_slots(spark: SparkSession, planned: dict[str, int], seed: int, shard_blocks: int) -> DataFrame:
    """shard, source, slot (numbered per source over all shards): how many slots of each shard a source fills is a
    multinomial draw with the planned slots as weights, given that all shards together hold the planned slots."""
    names = sorted(planned)
    need = np.array([planned[k] for k in names], dtype=np.int64)
    n_slots = int(need.sum())
    shards = -(-n_slots // shard_blocks) if n_slots else 0
    slots_to = lambda s: min(n_slots, s * shard_blocks)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # from all shards down to the last one drawn
        for b in batches:
            rows = []
            for s in b["id"].tolist():
                while path and not path[-1][0] <= s < path[-1][1]:
                    path.pop()
                if not path:
                    path.append((0, shards, need, np.zeros(len(need), np.int64)))
                while path[-1][1] - path[-1][0] > 1:
                    lo, hi, counts, before = path[-1]
                    middle = (lo + hi) // 2
                    left = halve(counts, slots_to(middle) - slots_to(lo), [seed, lo, hi])
                    path.append((lo, middle, left, before) if s < middle else (middle, hi, counts - left, before + left))
                _, _, counts, before = path[-1]
                rows += [(s, names[i], int(before[i]), int(c)) for i, c in enumerate(counts) if c]
            if rows:
                yield pd.DataFrame(rows, columns=["shard", "source", "before", "c"])

    drawn = spark.range(shards).mapInPandas(draw, "shard long, source string, before long, c long")
    return drawn.select("shard", "source", F.explode(F.expr("sequence(before, before + c - 1)")).alias("slot"))


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, block: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, tokenizer: str | None = None) -> DataFrame:
    """The mixture: shard, source, slot, repeat_no, block_no, n_tokens, tokens.

    ``total``: tokens wanted; null means as many as the documents of the target sources hold. Every source gets the slots
    planned for it, so shares are exact up to a block and no cap is passed.
    """
    spark = docs.sparkSession
    blocks = materialise(numbered_blocks(docs, tokenizer or default_tokenizer(spark), block), "numbered-blocks")
    facts = {r.source: (r.b, r.t) for r in blocks.groupBy("source").agg(F.count("*").alias("b"), F.sum("n_tokens").alias("t")).toLocalIterator()}
    want = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source IS NOT NULL").toLocalIterator()}
    sources = [{"source": k, "tokens": t, "target": want.get(k, (None, 0))[0], "cap": want.get(k, (None, 0))[1] or 0} for k, (b, t) in facts.items()]
    take = plan_totals(sources, total)
    planned = plan_slots(take, {k: (facts[k][0], facts[k][1], want[k][1]) for k in take})
    # One row per source: its number of blocks.
    room = spark.createDataFrame([(k, facts[k][0]) for k in planned] or [("", 0)], "source string, blocks long")
    fit = draw_slots(spark, planned, seed, shard_blocks).join(F.broadcast(room), "source")

    def place(slot: pd.Series, size: pd.Series, salt: pd.Series) -> pd.Series:
        n = np.maximum(1, size.to_numpy(np.int64))
        key = (salt.to_numpy(np.int64) ^ (slot.to_numpy(np.int64) // n * 1_000_003 + seed)) & 0x7FFFFFFFFFFFFFFF
        return pd.Series(permuted(slot.to_numpy(np.int64) % n, n, key))

    placed = fit.select(
        "shard", "source", "slot", (F.floor(F.col("slot") / F.col("blocks")) + 1).alias("repeat_no"),
        F.pandas_udf(place, "long")("slot", "blocks", F.xxhash64("source")).alias("block_no"),
    )
    return placed.join(blocks, ["source", "block_no"]).select("shard", "source", "slot", "repeat_no", "block_no", "n_tokens", "tokens")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """For every source of either table: target share, tokens taken, share reached, most repeats used and allowed."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("repeat_no").alias("most_repeats"))
    have = docs.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n_documents"))
    t = targets.select("source", "target_share", "max_repeats")
    # One row per source: the total is a sum over that small table.
    every = have.join(t, "source", "full").join(got, "source", "left").withColumn("total", F.sum("n_tokens").over(W.partitionBy()))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select(
        "source", zero("n_documents"), "target_share", "max_repeats", zero("n_tokens"), zero("most_repeats"),
        F.round(F.coalesce(F.col("n_tokens"), F.lit(0)) / F.greatest(F.coalesce("total", F.lit(1)), F.lit(1)), 6).alias("actual_share"),
    )
