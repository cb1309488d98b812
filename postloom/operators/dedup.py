"""Keep-first, keep-latest and near-duplicate grouping.

Nulls: a null key is a key of its own (rows with null keys are one group) unless said otherwise. Ties are broken by the
order columns, which must be unique for a defined result. Empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from postloom.functions.text import words
from postloom.session import materialise

_RANK = "_rank_in_group"


def ranked(df: DataFrame, key: list[Column | str], order: list[Column]) -> DataFrame:
    return df.withColumn(_RANK, F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def keep_first(df: DataFrame, key: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of every group in the given order."""
    return ranked(df, key, order).where(F.col(_RANK) == 1).drop(_RANK)


def rejected(df: DataFrame, key: list[Column | str], order: list[Column], reason: str, preview: str, chars: int = 120) -> DataFrame:
    """The rows that keep_first leaves out, with reason and the head of their text."""
    rest = ranked(df, key, order).where(F.col(_RANK) > 1).drop(_RANK)
    return rest.withColumn("reason", F.lit(reason)).withColumn("text_preview", F.substring(preview, 1, chars))


def new_rows(batch: DataFrame, seen: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row per key of a batch whose key was not seen before."""
    return keep_first(batch, [key], order).join(seen.select(key).distinct(), key, "left_anti")


def connected(pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """``id`` and ``root`` (the smallest id of its component) for every id in pairs (a, b).

    Large-star and small-star rounds: each round is two shuffles on ids, written to the shared folder; the number of rounds
    grows with the logarithm of the longest chain. Nothing but a changed-or-not flag reaches the driver.
    """
    edges = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = materialise(small.where("u > v").distinct(), "edges")
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


_LEVELS = [1, 3, 4]  # numbers of parts that sets are cut into
while _LEVELS[-1] < 10**9:
    _LEVELS.append(_LEVELS[-1] * 3 // 2)
_ITEMS = 1_000_000  # items worked on at once
_BITS = 1 << 24  # of the filter of ids that have a partner
_BUCKETS = 1 << 20  # of items, for their order
_PASSES, _PASS_ITEMS = 4, 5_000_000  # over what sets meet on: at most so many, one for so many items of all sets
PARTS = 0.85  # the least similarity at which whole parts are compared


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64 bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_row(order: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """order, rearranged by row; within a row it stays. 16 bits are sorted by radix."""
    return order[np.argsort(row[order].astype(np.uint16 if rows <= 1 << 16 else np.int64), kind="stable")]


def _runs(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of n words of every row as digests in order of rows, and the number of each row's; a row of fewer words is one run."""
    size = np.asarray(words.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(words.flatten()).view(np.uint64)
    count = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
    row = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(size) - size, count)
    long = np.minimum(size, n)[row]
    h = long.astype(np.uint64)
    for j in range(n):
        some = long > j
        h[some] = _mixed(h[some] * np.uint64(0x9E3779B97F4A7C15) + flat[at[some] + j])
    order = _by_row(np.argsort(h), row, len(size))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(h)]
    return h[new], np.bincount(row[new], minlength=len(size))


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about _ITEMS words at most."""
    for b in batches:
        ends = np.cumsum(np.asarray(b.column(1).value_lengths().fill_null(0)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _ITEMS, "right")))
            yield b.slice(at, to - at)
            at = to


def _signatures(h: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature, such that two similar rows have a signature in common; h: the items of all rows, ``size``: how many of each row.

    Sets of at most n items that are similar differ in at most D = 2n (1 - least) / (1 + least) items. Cut into more than D
    parts by digest, they agree on a whole part. The number of parts is that for the larger set; the smaller makes the
    signatures for all sizes that it may meet. One part more than needed is cut, and parts without items are left out: they
    can be all that two sets agree on only where both have two such parts. Those sets also make the items of a prefix
    (n - least n + 1 items in order of digests) signatures.
    """
    levels = np.array(_LEVELS)
    differ = lambda n: np.floor(2 * n * (1 - least) / (1 + least) + 1e-9)
    level = lambda n: np.searchsorted(levels, np.where(differ(n) > 0, differ(n) + 2, 1))
    own, most = level(size), level(np.floor(size / least + 1e-9))
    row, mixed, place = np.repeat(np.arange(len(size)), size), _mixed(h ^ np.uint64(0x5851F42D4C957F2D)), h >> np.uint64(32)
    rows, out, bare = [], [], np.zeros(len(size), bool)
    for more in range(int((most - own).max(initial=-1)) + 1):
        on = (own + more <= most) & (size > 0)
        parts = np.where(on, levels[np.minimum(own + more, len(levels) - 1)], 0)
        first = np.cumsum(parts) - parts
        mine = on[row]
        cell = first[row[mine]] + ((place[mine] * parts[row[mine]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, cell, mixed[mine])
        some = np.flatnonzero(np.bincount(cell, minlength=len(sums)))
        of = np.repeat(np.arange(len(size)), parts)[some]
        bare |= on & (parts - np.bincount(of, minlength=len(size)) >= 2)
        name = ((own[of] + more).astype(np.uint64) << np.uint64(32)) + (some - first[of]).astype(np.uint64)
        rows.append(of)
        out.append(_mixed(sums[some] ^ _mixed(name + np.uint64(1))))
    if bare.any():
        rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        head = bare[row] & (rank < (size - np.ceil(least * size - 1e-9) + 1)[row])
        rows.append(row[head])
        out.append(_mixed(h[head] ^ np.uint64(0xD1B54A32D192ED03)))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(out or [np.zeros(0, np.uint64)])


_WIDE = [f"w{i}" for i in range(8)]


def _sketches(h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """512 bits of every set in 8 words, each the parity of the items that fall on it: two sets' bits differ in at most as many
    places as the sets in items, also once words are folded onto each other."""
    row, bit = np.repeat(np.arange(len(size)), size), (_mixed(h) >> np.uint64(55)).astype(np.int64)
    odd = (np.bincount(row * 512 + bit, minlength=512 * len(size)) & 1).astype(np.uint8).reshape(-1, 512)
    words_ = np.packbits(odd, axis=1).view(np.int64)
    return [words_[:, i].copy() for i in range(len(_WIDE))]


def _counts(rows: DataFrame, n: int) -> np.ndarray:
    """How many sets have an item of each of _BUCKETS buckets; that many numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(_BUCKETS, np.int64)
        for b in _in_slices(batches):
            out += np.bincount((_runs(b.column(1), n)[0] >> np.uint64(32)).astype(np.int64) % _BUCKETS, minlength=_BUCKETS)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["bucket", "n"])

    got = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_BUCKETS, np.int32)
    out[got["bucket"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    return out


def _prefixes(h: np.ndarray, size: np.ndarray, least: float, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and item of the first n - least n + 1 items of every set in one order of all items, from rare to frequent by bucket:
    similar sets have one of these in common. Rows are in order. An item of one set only is left out."""
    row, c = np.repeat(np.arange(len(size)), size), counts[(h >> np.uint64(32)).astype(np.int64) % _BUCKETS]
    order = _by_row(np.argsort(np.minimum(c, (1 << 16) - 1).astype(np.uint16), kind="stable"), row, len(size))  # h is in order already
    rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    order = order[(rank < (size - np.ceil(least * size - 1e-9) + 1)[row]) & (c[order] > 1)]
    return row[order], h[order]


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with ``likely``: whether their id is among ids, or seems so: by a filter of fixed size, without a shuffle of rows."""
    bit = F.pmod(F.xxhash64("id"), F.lit(_BITS))
    bits = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("bucket"), "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)).alias("likely"))


def _holding(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose ids are in pairs (a, b), and some more."""
    return _likely(rows, pairs.select(F.explode(F.array("a", "b")).alias("id"))).where("likely").drop("likely")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ids; only those that may be are shuffled. rows is computed twice."""
    marked = _likely(rows, ids)
    return marked.where(~F.col("likely")).drop("likely").unionByName(marked.where("likely").drop("likely").join(ids, "id", "left_anti"))


def _may_be_similar(least: float, words_: list[str]) -> Column:
    """By sizes and sketches."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in words_])
    return (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9) & (differ <= (F.col("na") + F.col("nb")) * (1 - least) / (1 + least) + 1e-9)


_NARROW = ["p", "q"]  # 128 bits


def _folded() -> list[Column]:
    return [reduce(Column.bitwiseXOR, [F.col(w) for w in _WIDE[4 * i : 4 * i + 4]]).alias(c) for i, c in enumerate(_NARROW)]


def _side(rows: DataFrame, side: str, words_: list[str], *more: Column | str) -> DataFrame:
    return rows.select(*more, F.col("id").alias(side), *(F.col(c).alias(c + side) for c in ("n", *words_)))


def _alike(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may be similar by sizes and whole sketches (id, n and _WIDE)."""
    short = sketches.select("id", "n", *_WIDE).dropDuplicates(["id"])
    return pairs.join(_side(short, "a", _WIDE), "a").join(_side(short, "b", _WIDE), "b").where(_may_be_similar(least, _WIDE)).select("a", "b")


def _meeting(rows: DataFrame, hot: int) -> DataFrame:
    """Pairs of rows (sig and others) on one sig, as sides a and b; one with more than ``hot`` rows is split over salts."""
    shared = rows.groupBy("sig").agg((F.floor(F.count("*") / hot) + 1).cast("int").alias("salts"))
    salted = rows.join(shared, "sig")
    a = _side(salted, "a", _NARROW, "sig", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    b = _side(salted, "b", _NARROW, "sig", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["sig", "salt"]).where("a < b")


def _similar(rows: DataFrame, least: float, n: int, hot: int) -> DataFrame:
    """Pairs (a, b), a < b, and ``similarity`` of the ids of rows (id, ws: array of digests of words) whose sets of runs of n words
    are similar. Rows with equal ids must have equal words; rows is computed several times.

    Only signatures are shuffled for all rows, never texts or sets. From PARTS on these are digests of whole parts, which
    few other rows share; below it the parts get small, and rare items with sketches of their sets take their place. These
    are written once, narrow, and meet in passes, so that of many rows a part is shuffled at a time. What meets and may be
    similar by size and sketch is compared whole.
    """
    kind = rows.schema["id"].dataType
    ints = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    lists = lambda *names: [T.StructField(c, T.ArrayType(T.LongType())) for c in names]
    key = T.StructField("id", kind)
    counts = None if least >= PARTS else _counts(rows, n)
    passes = 1 if counts is None else int(min(_PASSES, 1 + counts.sum(dtype=np.int64) // _PASS_ITEMS))
    sigs = [f"s{k}" for k in range(passes)]
    in_rows = lambda h, size: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(h.view(np.int64)))

    def sign_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_slices(batches):
            at, s = _signatures(*_runs(b.column(1), n), least)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), b.column(0).take(pa.array(at))], ["sig", "id"])

    def sign_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_slices(batches):
            h, size = _runs(b.column(1), n)
            at, s = _prefixes(h, size, least, counts)
            turn = s % np.uint64(passes)
            each = [in_rows(s[turn == k], np.bincount(at[turn == k], minlength=len(size))) for k in range(passes)]
            out = pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (size, *_sketches(h, size))), *each], ["id", "n", *_WIDE, *sigs])
            yield out.filter(pa.array(np.bincount(at, minlength=len(size)) > 0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_slices(batches):
            h, size = _runs(b.column(1), n)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (size, *_sketches(h, size))), in_rows(h, size)], ["id", "n", *_WIDE, "hs"])

    def sets_of(pairs: DataFrame) -> DataFrame:
        return materialise(_holding(rows, pairs).mapInArrow(whole, T.StructType([key, *ints("n", *_WIDE), *lists("hs")])), "sets")

    of = W.partitionBy("sig")
    if counts is None:
        met = rows.mapInArrow(sign_parts, T.StructType([*ints("sig"), key])).withColumns({"lo": F.min("id").over(of), "hi": F.max("id").over(of)}).where("lo <> hi").select("sig", "id").distinct()
        met = materialise(met.withColumns({c: F.lit(0).cast("long") for c in ("n", *_NARROW)}), "signatures")
        near = materialise(_meeting(met, hot).select("a", "b").distinct(), "candidates")
        # Few rows have a candidate; fewer are left when sketches are compared.
        sets = sets_of(near)
        near = materialise(_alike(near, sets, least), "candidates")
    else:
        signed = materialise(rows.mapInArrow(sign_rare, T.StructType([key, *ints("n", *_WIDE), *lists(*sigs)])), "rare")
        near = None
        for s in sigs:
            # Both sides read one exchange; what is hot is joined apart.
            met = signed.select("id", "n", *_folded(), s).select(F.explode(s).alias("sig"), "id", "n", *_NARROW)
            met = met.repartition("sig").distinct().withColumn("c", F.count("*").over(of))
            few, many = met.where(F.col("c") <= hot), met.where(F.col("c") > hot)
            pairs = _side(few, "a", _NARROW, "sig").join(_side(few, "b", _NARROW, "sig"), "sig").where("a < b").where(_may_be_similar(least, _NARROW)).select("a", "b")
            pairs = pairs.unionByName(_meeting(many, hot).where(_may_be_similar(least, _NARROW)).select("a", "b"))
            pairs = materialise(pairs.distinct(), "candidates")
            near = pairs if near is None else near.unionByName(pairs)
        near = materialise(_alike(near.distinct(), _holding(signed, near), least), "candidates")
        sets = sets_of(near)
    sets = _holding(sets, near).dropDuplicates(["id"])
    ja, jb = sets.select(F.col("id").alias("a"), F.col("hs").alias("ha")), sets.select(F.col("id").alias("b"), F.col("hs").alias("hb"))
    inter = F.size(F.array_intersect("ha", "hb"))
    return near.join(ja, "a").join(jb, "b").select("a", "b", (inter / (F.size("ha") + F.size("hb") - inter)).alias("similarity")).where(F.col("similarity") >= least)


def similar_pairs(sets: DataFrame, least: float, hot: int = 2_000) -> DataFrame:
    """All pairs (a, b), a < b, of rows of sets (id, items: array of distinct strings) whose Jaccard similarity is ``least``
    or more, with ``similarity``. Exact: no pair is lost and none is approximate.

    What more than ``hot`` sets meet on is split over salts, its other side repeated once per salt, so that no task holds
    such a group whole.
    """
    # Digests keep what is shuffled narrow; equal digests of different items are beyond reach at 64 bits for sets that are then compared whole.
    return _similar(sets.select("id", F.transform("items", lambda x: F.xxhash64(x)).alias("ws")), least, 1, hot)


def _copies(df: DataFrame, id_col: str, text_col: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """id, ``head`` (the smallest id with the same words), ``k`` (a digest of the words) and ``n_words`` of every row, written once;
    and (id: the digest, ws: the words' digests) of the rows with words, made anew from df by each reader."""
    ws = words(F.col(text_col), pattern)
    text = F.array_join("ws", " ")
    tokens = df.select(F.col(id_col).alias("id"), ws.alias("ws"))
    keyed = tokens.select("id", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("d"), F.xxhash64(text).alias("k"), F.size("ws").alias("n_words"))
    rows = keyed.select("id", F.min("id").over(W.partitionBy("d")).alias("head"), "k", "n_words")
    bare = df.select(ws.alias("ws")).where(F.size("ws") > 0).select(F.xxhash64(text).alias("id"), F.transform("ws", lambda x: F.xxhash64(x)).alias("ws"))
    return materialise(rows, "copies"), bare


def _similar_heads(rows: DataFrame, texts: DataFrame, least: float, n: int) -> DataFrame:
    """Pairs (a, b), a < b, of heads whose texts are similar, written once."""
    heads = rows.where("id = head AND n_words > 0").select("k", "head")
    pairs = _similar(texts, least, n, 2_000).select("a", "b")
    pairs = pairs.join(heads.select(F.col("k").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("k").alias("b"), F.col("head").alias("y")), "b")
    return materialise(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "similar")


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, n: int = 5, least: float = 0.8) -> DataFrame:
    """id, ``copy_of`` (the smallest id with the same words), ``class_id`` (the smallest id that is linked to it by
    similar texts) and ``n_links`` (different texts that its text is similar to), one row per row of df.

    Rows with the same words are grouped first, so that copies are never expanded into pairs. A text without words (also
    null) is in a class of its own with the others like it.
    """
    rows, texts = _copies(df, id_col, text_col, r"[\p{L}\p{N}]+")
    pairs = _similar_heads(rows, texts, least, n)
    links = pairs.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count("*").alias("n_links"))
    root = connected(pairs.select("a", "b")).withColumnRenamed("id", "head")
    out = rows.select("id", "head").join(root, "head", "left").join(links, "head", "left")
    return out.select(F.col("id").alias(id_col), F.col("head").alias("copy_of"), F.coalesce("root", "head").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_dedupe(df: DataFrame, id_col: str, text_col: str, n: int = 3, least: float = 0.9, rounds: int = 1000) -> DataFrame:
    """id and ``kept`` of every row: in the order of ids, a row is dropped if its set of n-word shingles is similar (Jaccard)
    to that of an earlier row that is kept. Texts with fewer words are one shingle; those without words are kept.

    Rows with the same words follow the first of them. Of the rest, each round keeps the rows all of whose earlier partners
    are dropped and drops those with a kept earlier partner; the number of rounds is that of the longest chain of undecided
    rows, and not reaching its end is an error, not a result.
    """
    rows, texts = _copies(df, id_col, text_col, "[A-Za-z0-9]+")
    pairs = _similar_heads(rows, texts, least, n)
    open_ = pairs  # pairs both of whose rows are undecided
    dropped = None
    for _ in range(rounds):
        first = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        gone = materialise(open_.join(first.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        if gone.isEmpty():
            break
        dropped = gone if dropped is None else dropped.unionByName(gone)
        decided = gone.unionByName(first)
        left = open_.join(decided.withColumnRenamed("id", "a"), "a", "left_anti").join(decided.withColumnRenamed("id", "b"), "b", "left_anti")
        open_ = materialise(left.select("a", "b"), "undecided")
    else:
        raise RuntimeError(f"undecided rows after {rounds} rounds")
    out = rows.select("id", "head", "n_words")
    if dropped is not None:
        out = out.join(dropped.select(F.col("id").alias("head"), F.lit(True).alias("gone")), "head", "left")
    else:
        out = out.withColumn("gone", F.lit(None).cast("boolean"))
    kept = F.col("gone").isNull() & ((F.col("id") == F.col("head")) | (F.col("n_words") == 0))
    return out.select(F.col("id").alias(id_col), kept.alias("kept"))
