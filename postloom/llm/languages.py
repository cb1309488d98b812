"""The language of every document and of every segment of a mixed document.

A bit-sliced Bloom filter holds the n-grams of all languages at once: each slot is a byte whose bit L belongs to language
L, and the AND of an n-gram's slots gives all languages that contain it. A segment's popcount per language, corrected for
the filter's false positives, decides; the margin to the next language is the confidence.

N-grams are whole words, pairs of words and the letter runs (3 to 5) of a word with its edges. Which language contains an
n-gram is counted over a reference table with known languages: it must occur there, and not far less often than in the language
where it is most frequent, so that words borrowed in passing and the odd foreign passage set no bit. N-grams in no language, such as
names, have no say.

Defined results: null, blank and wordless texts have no segments and no language; ties go to the language listed first;
repeated rows get equal results; texts are processed whole; an empty reference gives a filter that knows nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.canonical import canonical_form, folded, reader_form
from postloom.session import materialise

LANGUAGES = ["en", "tl", "ceb", "ilo", "es"]
HASHES, SLOTS_EACH, LEAST_SLOTS, MOST_SLOTS, BLOCK = 3, 12, 1 << 21, 1 << 28, 1 << 16
MIN_COUNT, MIN_PART, KEEP = 3, 0.15, 1e-6
_BITS, _FULL = 24, (1 << 24) - 1  # of a packed count

# What the labels that come with posts mean.
LABELS = {
    "en": "en", "eng": "en", "english": "en", "tl": "tl", "fil": "tl", "tgl": "tl", "filipino": "tl", "tagalog": "tl", "ceb": "ceb", "cebuano": "ceb",
    "bisaya": "ceb", "ilo": "ilo", "ilokano": "ilo", "ilocano": "ilo", "es": "es", "spa": "es", "spanish": "es", "taglish": "en+tl",
}

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: Addresses (also with the signs spelled out), tags, mentions, stamps and tokens with figures tell no language.
#: Nothing that has matched is given back where a shorter match can't go on either.
_ADDRESS = r"|\S+\s*(?:@|[\[(]\s*at\s*[\])])\s*\S+(?:\s*[\[(]\s*dot\s*[\])]\s*\S+)*"
_LINK, _TAG_OR_FIGURES = r"https?://\S+|www\.\S+", (
    rf"|[#@]\S+|(?:\w++:\s*)?{_MONTH}\.?\s+\d+,?\s+\d+(?:,?\s+\d+:\d+\S*)?(?:\s*[ap]m\b)?(?:\s*(?:utc|gmt|pht|[a-z]{{2,4}}t)\b\S*)?|[^\s\d]*+\d\S*"
)
_SKIP = re.compile(_LINK + _ADDRESS + _TAG_OR_FIGURES)
_SKIP_FEW = re.compile(_LINK + _TAG_OR_FIGURES)  # where no sign of an address is
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Ends of segments: terminators before a blank or a letter, line breaks. A dot before a small letter (an abbreviation,
#: trailing dots) does not cut.
_CUT = re.compile(r"([!?.…]+)(?:(?<=[!?])(?:\s+|(?=[^\W\d_]))|(?<=[.…])\s+(?![a-z])|(?<=[a-z]{2}\.)(?=[A-Z]))|\n+")


_SIGNS = re.compile(r"[\d@#]|www|\(at|\[at")
_ADDRESS_SIGNS = re.compile(r"[@\[(]")
_FIGURES = re.compile(r"\d+")


def words_of(piece: str) -> list[str]:
    """The words of a piece of readable text that can tell a language: not addresses, tags, mentions or tokens with figures."""
    t = piece.casefold()
    if not t.isascii():
        t = canonical_form(t)
    if _SIGNS.search(t):
        t = (_SKIP if _ADDRESS_SIGNS.search(t) else _SKIP_FEW).sub(" ", t)
    return _WORD.findall(t)


def _pairs(words: list[str]) -> Iterator[str]:
    return map(" ".join, zip(words, words[1:], strict=False))


def plain_piece(piece: str) -> str:
    """A piece without its leading tag and with all figures alike: pieces that are equal in this form hold the same words."""
    if piece.startswith("#"):
        piece = piece.partition(" ")[2]
    return _FIGURES.sub("0", piece)


def segments_of(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each sentence-like piece of a text, terminators included."""
    at = 0
    for m in _CUT.finditer(text):
        end = m.end(m.lastindex) if m.lastindex else m.start()
        if end > at:
            yield at, end
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w, *(w[i : i + n] for n in (3, 4, 5) if n < len(w) for i in range(len(w) - n + 1))]


def _slots(gram: str, size: int) -> tuple[int, ...]:
    b = gram.encode()
    h1, h2 = zlib.crc32(b), zlib.adler32(b) * 2654435761 + zlib.crc32(b, 0x9E3779B9)
    return tuple((h1 + i * (h2 | 1)) % size for i in range(HASHES))


def label_set(col: Column) -> Column:
    """A label as the sorted array of the languages it names; null where it names none."""
    lookup = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    parts = F.transform(F.split(F.lower(F.trim(col)), r"\s*[+/,&]\s*"), lambda p: F.coalesce(F.try_element_at(lookup, p), F.lit("")))
    flat = F.array_sort(F.array_distinct(F.array_remove(F.flatten(F.transform(parts, lambda p: F.split(p, r"\+"))), "")))
    return F.when(F.size(flat) > 0, flat)


_COLS = [f"c{i}" for i in range(len(LANGUAGES))]
_COUNTS = "gram string, " + ", ".join(f"{c} long" for c in _COLS)
_INDEX = {v: i for i, v in enumerate(LANGUAGES)}


class _Counts:
    """Counts per n-gram and language inside one partition."""

    def __init__(self) -> None:
        self.seen: dict[str, list[int]] = {}

    def add_held(self, held: dict[str, Counter]) -> None:
        """Adds and clears the counted segments of each language."""
        for lang, pieces in held.items():
            own, i = Counter(), _INDEX[lang]
            for p, n in pieces.items():
                words = words_of(p)
                if n == 1:
                    own.update(words)
                    own.update(_pairs(words))
                else:
                    for g in (*words, *_pairs(words)):
                        own[g] += n
            for g, n in own.items():
                have = self.seen.get(g)
                if have is None:
                    have = self.seen[g] = [0] * len(LANGUAGES)
                have[i] += n
        held.clear()

    def out(self, least: int = 0) -> Iterator[pd.DataFrame]:
        if len(self.seen) > least:
            yield pd.DataFrame([(g, *c) for g, c in self.seen.items()], columns=["gram", *_COLS])
            self.seen.clear()


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COLS])


def count_words(reference: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Words and pairs of words per language of a table with one language per row, over all its rows: counted inside each
    partition first, once per distinct segment."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, held = _Counts(), {}
        for b in batches:
            for lng, part in b.groupby(lang):
                own = held.setdefault(lng, Counter())
                for t, n in Counter(part[text]).items():
                    t = reader_form(t)
                    for x, y in segments_of(t):
                        own[plain_piece(t[x:y])] += n
            if sum(map(len, held.values())) > 200_000:
                c.add_held(held)
                yield from c.out(300_000)
        c.add_held(held)
        yield from c.out()

    rows = reference.where(F.col(text).isNotNull() & F.col(lang).isin(LANGUAGES)).select(text, lang)
    return _summed(rows.mapInPandas(count, _COUNTS))


def build_filter(words: DataFrame) -> dict:
    """The filter from counts of words and pairs: slots (bytes, as many as the n-grams ask for) and the false-positive rate of each language.

    The letter runs of a word are counted from the words' counts. What reaches the driver is the finished filter, in blocks.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _Counts()
        for b in batches:
            for g, *n in b.itertuples(index=False, name=None):
                for x in (g,) if " " in g else _grams(g):
                    have = c.seen.setdefault(x, [0] * len(LANGUAGES))
                    for i, k in enumerate(n):
                        have[i] += k
            yield from c.out(300_000)
        yield from c.out()

    grams = materialise(_summed(_summed(words).mapInPandas(runs, _COUNTS)), "ngrams")
    totals = [float(x or 0) for x in grams.agg(*[F.sum(c) for c in _COLS]).first()]
    rates = [F.col(c) / max(t, 1.0) for c, t in zip(_COLS, totals, strict=True)]
    top = F.greatest(*rates)
    mask = reduce(Column.bitwiseOR, [F.when((F.col(c) >= MIN_COUNT) & (r >= KEEP / 10) & (r >= MIN_PART * top), 1 << i).otherwise(0) for i, (c, r) in enumerate(zip(_COLS, rates, strict=True))])
    members = grams.select("gram", mask.cast("int").alias("mask")).where("mask > 0")
    size = filter_size(members.count())

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"slot": [s for g in b["gram"] for s in _slots(g, size)], "mask": np.repeat(b["mask"].to_numpy(), HASHES)})

    def block(b: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BLOCK, np.uint8)
        out[b["slot"].to_numpy() % BLOCK] = b["mask"].to_numpy()
        return pd.DataFrame({"k": [b["slot"].iloc[0] // BLOCK], "s": [zlib.compress(out.tobytes(), 1)]})

    # Each slot's bits are OR-ed before slots meet in blocks, so a block is made of at most BLOCK rows.
    merged = members.mapInPandas(slots_of, "slot long, mask int").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    got = merged.groupBy(F.expr(f"slot div {BLOCK}").alias("b")).applyInPandas(block, "k long, s binary").toPandas()
    slots = np.zeros(size, np.uint8)
    for k, s in zip(got["k"], got["s"], strict=True):
        slots[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(zlib.decompress(s), np.uint8)
    fill = np.array([np.mean((slots >> i) & 1) for i in range(len(LANGUAGES))])
    return {"slots": zlib.compress(slots.tobytes(), 1), "false": (fill**HASHES).tolist()}


def filter_size(members: int) -> int:
    """Slots for so many n-grams: at least SLOTS_EACH for each, a power of two. A filter that would not fit into a task is refused."""
    size = max(LEAST_SLOTS, 1 << (SLOTS_EACH * max(1, members) - 1).bit_length())
    if size > MOST_SLOTS:
        raise ValueError(f"{members} n-grams need {size} slots, more than {MOST_SLOTS}; raise KEEP or MOST_SLOTS")
    return size


class _Words(dict):
    """What a filter has of each word or pair of words, worked out when it is first asked for.

    Hits per language, n-grams known and whether the whole word (or pair) is known, packed into one integer, so that the counts
    of many words are added at once.
    """

    def __init__(self, slots: bytes):
        super().__init__()
        self.slots = slots

    def _mask(self, gram: str) -> int:
        m = 255
        for s in _slots(gram, len(self.slots)):
            m &= self.slots[s]
        return m

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        pair = " " in word
        first = self._mask(word if pair else f"<{word}>")
        got = 0
        if first:
            # A whole word or a pair of words says more than one of its letter runs.
            masks = [(first, 4)] + ([] if pair else [(self._mask(g), 1) for g in _grams(word)[1:]])
            for i in range(len(LANGUAGES)):
                got += sum(w for m, w in masks if m >> i & 1) << _BITS * i
            got += sum(w for m, w in masks if m) << _BITS * len(LANGUAGES)
            got += (0 if pair else 1) << _BITS * (len(LANGUAGES) + 1)
        self[word] = got
        return got


class Decider:
    """Decides the language of pieces of text by a filter."""

    def __init__(self, built: dict):
        self.false = built["false"]
        self.words = _Words(zlib.decompress(built["slots"]))
        self.known: dict[str, tuple[str | None, float, int] | None] = {}
        self.raw: dict[str, tuple[str | None, float, int] | None] = {}

    def score(self, words: list[str]) -> tuple[list[float], int]:
        """The corrected share of n-grams in each language, and how many words are known."""
        word = self.words.__getitem__
        total = sum(map(word, words)) + sum(map(word, _pairs(words)))
        n = total >> _BITS * len(LANGUAGES) & _FULL
        if not n:
            return [0.0] * len(LANGUAGES), 0
        shares = [((total >> _BITS * i & _FULL) / n - f) / (1 - f) for i, f in enumerate(self.false)]
        return [min(1.0, max(0.0, x)) for x in shares], total >> _BITS * (len(LANGUAGES) + 1)

    def segment(self, piece: str) -> tuple[str | None, float, int] | None:
        """Language, confidence and known words of one segment; None without words. Segments of the same words are decided once."""
        got = self.raw.get(piece, 0)
        if got != 0:
            return got
        if len(self.raw) > 200_000:
            self.raw.clear()
        plain = plain_piece(piece)
        got = self.known.get(plain, 0)
        if got == 0:
            if len(self.known) > 200_000:
                self.known.clear()
            w = words_of(plain)
            got = None
            if w:
                s, known = self.score(w)
                best, next_ = sorted(s, reverse=True)[:2]
                got = (LANGUAGES[s.index(best)] if best > 0 else None, (best - next_) * min(1.0, known / 4), known)
            self.known[plain] = got
        self.raw[piece] = got
        return got

    def languages(self, text: str) -> dict[str, float]:
        """The languages of a text with their confidence, as ``decide`` has it."""
        text = reader_form(text)
        segment = self.segment
        return decide([(a, b, *got) for a, b in segments_of(text) if (got := segment(text[a:b])) is not None])

    def segments(self, text: str) -> list[tuple[int, int, str | None, float, int]]:
        """begin, end, language, confidence and known words of each segment with words; places are those in the stored text."""
        seen, begin, end = folded(text)
        at = lambda a, b: (a, b) if begin is None else (begin[a], end[b - 1])
        return [(*at(a, b), *got) for a, b in segments_of(seen) if (got := self.segment(seen[a:b])) is not None]


MIN_WORDS, MIN_CONFIDENCE = 4, 0.12


def decide(segments: list[tuple[int, int, str | None, float, int]]) -> dict[str, float]:
    """The languages of a document: those of at least one segment of enough known words and confidence; of a document
    without such a segment the one of its clearest segment. With the best confidence of each."""
    out: dict[str, float] = {}
    for _, _, lang, conf, known in segments:
        if lang and known >= MIN_WORDS and conf >= MIN_CONFIDENCE:
            out[lang] = max(out.get(lang, 0.0), conf)
    if not out:
        clear = [(c, k, lang) for _, _, lang, c, k in segments if lang]
        if clear:
            c, _, lang = max(clear, key=lambda x: (x[0], x[1]))
            out[lang] = c
    return out


def count_agreeing(df: DataFrame, built: dict, text: str, label: str, part: float = 0.5) -> DataFrame:
    """Word counts of the rows whose label (a sorted array of languages) names one language in which at least ``part`` of
    their segments are, too. They teach the filter words that the first reference lacks; wrong labels are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, c, held = Decider(built), _Counts(), {}
        for b in batches:
            for t, lang in zip(b[text], b["lang"], strict=True):
                t = reader_form(t)
                pieces = [t[x:y] for x, y in segments_of(t)]
                decided = [got for p in pieces if (got := d.segment(p)) is not None]
                if decided and sum(x[0] == lang for x in decided) >= part * len(decided):
                    held.setdefault(lang, Counter()).update(map(plain_piece, pieces))
            if sum(map(len, held.values())) > 200_000:
                c.add_held(held)
                yield from c.out(300_000)
        c.add_held(held)
        yield from c.out()

    one = df.where((F.size(label) == 1) & F.col(text).isNotNull()).select(F.col(text).alias(text), F.col(label)[0].alias("lang"))
    return _summed(one.mapInPandas(run, _COUNTS))


def detect(df: DataFrame, built: dict, text: str, keep: list[str], with_segments: bool = False) -> DataFrame:
    """The columns ``keep``, ``langs`` (sorted, joined by ``+``, empty if none), ``confidence`` (of the least sure of them)
    and, if asked for, ``segments`` (begin, end, lang, confidence)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Decider(built)
        for b in batches:
            out = b[keep].copy()
            rows = [d.segments(t) if isinstance(t, str) else [] for t in b[text]] if with_segments else []
            langs = [decide(s) for s in rows] if with_segments else [d.languages(t) if isinstance(t, str) else {} for t in b[text]]
            out["langs"] = ["+".join(sorted(x)) for x in langs]
            out["confidence"] = [min(x.values(), default=None) for x in langs]
            if with_segments:
                out["segments"] = [[{"begin": x[0], "end": x[1], "lang": x[2], "confidence": x[3]} for x in s] for s in rows]
            yield out

    more = ", langs string, confidence double" + (", segments array<struct<begin:int,end:int,lang:string,confidence:double>>" if with_segments else "")
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep) + more
    return df.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)
