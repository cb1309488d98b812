"""Text that looks the same, in one consistent form.

``reader`` is what a reader sees: compatibility normalisation in composed form (NFKC), mapped white space and look-alike
letters, default-ignorable characters removed. Letters are mapped on the decomposed text, so a mark stays on whatever
letter it is on. ``canonical`` is the form for comparisons: the reader's form, fully case folded, with the folds of all
look-alikes mapped, so that capitals and small letters of one word meet whatever script they are typed in (small Cyrillic
letters, say, whose capitals look Latin). Both are computed in Arrow batches, once per distinct value of a task, and texts of
plain ASCII skip the tables.

Two small Greek letters look like other Latin letters than their capitals do (nu like v, upsilon like u). They can't be both,
so they are no look-alikes to the reader's form, and follow their capitals in the canonical one.

Defined results: null stays null; the empty text stays empty; a text of ignorable characters only becomes empty; texts of
any length are processed whole; repeated rows have equal results; line breaks stay line breaks, all other blanks become
one plain blank each; a joiner between two pictographs stays, since it changes what is seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import materialise

# Letters of other scripts that look like a Latin letter.
LOOK_ALIKE = dict(
    zip(
        # Cyrillic small, Cyrillic capital, Greek small, Greek capital, Armenian, others
        "аеорсухіјѕһԁԛԝѵɡӏ" "АВЕКМНОРСТУХІЈЅҮԌԚԜѴ" "οαικρϲϳ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ" "օոսհցզՕՍՏ" "ıɑ",
        "aeopcyxijshdqwvgl" "ABEKMHOPCTYXIJSYGQWV" "oaikpcj" "ABEZHIKMNOPTYXCJ" "onuhgqOUS" "ia",
        strict=True,
    )
)
#: What is left after case folding: the folds of the look-alikes.
FOLDED = {k.casefold(): v.casefold() for k, v in LOOK_ALIKE.items()}
#: Ranges of default-ignorable code points (public Unicode data), and the blanks and line breaks that are mapped.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
BLANKS = "\t \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BREAKS = "\u000b\u000c\u0085\u2028\u2029\r"

_DROP = {c: None for a, b in IGNORABLE for c in range(a, b + 1)}
_MAP = {ord(c): " " for c in BLANKS} | {ord(c): "\n" for c in BREAKS} | {ord(k): v for k, v in LOOK_ALIKE.items()}
_TABLE = {chr(k): v or "" for k, v in (_DROP | _MAP).items()}
#: Only what has to change is looked up: a class search is far cheaper than a table look-up per character.
_SPECIAL = re.compile("[" + "".join(re.escape(c) for c in _TABLE if c > " " and not 0xE0000 <= ord(c) <= 0xE0FFF) + "\t\v\f\r\U000e0000-\U000e0fff]")


def _special(m: re.Match) -> str:
    return _TABLE[m[0]]


def _pictograph(c: str) -> bool:
    o = ord(c)
    return o >= 0x1F000 or 0x2600 <= o <= 0x27BF or 0x2190 <= o <= 0x21FF or 0x2B00 <= o <= 0x2BFF


_FOLDED = str.maketrans(FOLDED)


def reader_form(text: str) -> str:
    """The letters, marks and line breaks that a reader sees, in one spelling."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").replace("\v", "\n").replace("\f", "\n")
    joined = "\u200d" in text
    if joined:
        text = "".join("\ue000" if c == "\u200d" and 0 < i < len(text) - 1 and _pictograph(text[i - 1]) and _pictograph(text[i + 1]) else c for i, c in enumerate(text))
    # Mapped twice: what is special may hide in a compatibility form, and a form may compose only once that is gone.
    text = unicodedata.normalize("NFKD", _SPECIAL.sub(_special, text.replace("\r\n", "\n")))
    if not text.isascii():
        text = unicodedata.normalize("NFC", _SPECIAL.sub(_special, text))
    return text.replace("\ue000", "\u200d") if joined else text


def folded_form(seen: str) -> str:
    """A reader's form, fully case folded, with the folds of look-alikes mapped."""
    if seen.isascii():
        return seen.lower()
    key = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", seen.casefold()).casefold()).translate(_FOLDED)
    return unicodedata.normalize("NFC", key)


def canonical_form(text: str) -> str:
    """The form in which comparisons work."""
    return folded_form(reader_form(text))


_IGNORED = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in IGNORABLE) + "]")


def folded(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The text as read, and for each of its characters where it begins and ends in the stored text (None: the same)."""
    if text.isascii():
        return text, None, None
    out, begin, end = [], [], []
    at = 0
    for m in _ODD.finditer(text):  # everything between is as read
        out.append(text[at : m.start()])
        begin += range(at, m.start())
        end += range(at + 1, m.start() + 1)
        at = m.end()
        seen = _fold(m[0])
        out.append(seen)
        begin += [m.start()] * len(seen)
        end += [at] * len(seen)
    out.append(text[at:])
    begin += range(at, len(text))
    end += range(at + 1, len(text) + 1)
    return "".join(out), begin, end


#: A character outside ASCII with the marks on it, or an ASCII letter with marks.
_ODD = re.compile("[^\\x00-\\x7f\\u0300-\\u036f][\\u0300-\\u036f]*|[\\x00-\\x7f]?[\\u0300-\\u036f]+")
_FOLDS: dict[str, str] = {}


def _fold(cluster: str) -> str:
    got = _FOLDS.get(cluster)
    if got is None:
        got = "" if _IGNORED.fullmatch(cluster) else reader_form(cluster)
        if len(_FOLDS) < 100_000:
            _FOLDS[cluster] = got
    return got


REMEMBERED = 50_000  # values whose form a task remembers at once


def _per_distinct(form):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for s in batches:
            if len(known) > REMEMBERED:
                known.clear()
            codes, values = pd.factorize(s, use_na_sentinel=True)
            done = []
            for v in values:
                got = known.get(v)
                done.append(known.setdefault(v, form(v)) if got is None else got)
            yield pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return run


def canonical(col: Column | str) -> Column:
    return F.pandas_udf(_per_distinct(canonical_form), "string", F.PandasUDFType.SCALAR_ITER)(col)


def reader(col: Column | str) -> Column:
    return F.pandas_udf(_per_distinct(reader_form), "string", F.PandasUDFType.SCALAR_ITER)(col)


_DIGESTS = "struct<stored:binary,seen:binary,key:binary>"


def _digests(s: pd.Series) -> pd.DataFrame:
    """128-bit digests of the stored text, the reader's form and the canonical form, once per distinct value."""
    codes, values = pd.factorize(s, use_na_sentinel=True)
    done = []
    for v in values:
        seen = reader_form(v)
        key = folded_form(seen)
        stored_digest = md5(v.encode("utf-8", "surrogatepass")).digest()
        seen_digest = stored_digest if seen == v else md5(seen.encode("utf-8", "surrogatepass")).digest()
        done.append((stored_digest, seen_digest, md5(key.encode("utf-8", "surrogatepass")).digest()))
    done.append((None, None, None))  # code -1: null
    return pd.DataFrame([done[c] for c in codes], columns=["stored", "seen", "key"])


def same_reading_pairs(df: DataFrame, id_col: str, text_col: str, hot: int = 20_000) -> DataFrame:
    """Pairs (a, b), a < b, of rows whose texts differ as stored but show a reader the same.

    Candidates are the rows with equal canonical form; the exact check compares the reader's form, which keeps case. Texts
    are read once; only their 128-bit digests are kept (in the shared folder), and rows whose form has one stored spelling
    only are gone before the pairing. Pairs are formed by an equi-join on the two forms; a form with more than ``hot`` rows
    is split over salts, its other side repeated once per salt, so that no task holds such a group whole.
    """
    digest = F.pandas_udf(_digests, _DIGESTS)
    digests = materialise(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), digest(text_col).alias("d")).select("id", "d.*"), "digests")
    groups = digests.groupBy("key", "seen").agg(F.count("*").alias("n"), F.min("stored").alias("lo"), F.max("stored").alias("hi"))
    groups = groups.where("lo <> hi").select("key", "seen", (F.floor(F.col("n") / hot) + 1).cast("int").alias("salts"))
    rows = materialise(digests.join(groups, ["key", "seen"]), "spelled-apart")
    a = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).select("key", "seen", "salt", F.col("id").alias("a"), F.col("stored").alias("sa"))
    b = rows.select("key", "seen", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("b"), F.col("stored").alias("sb"))
    return a.join(b, ["key", "seen", "salt"]).where("a < b AND sa <> sb").select("a", "b")
