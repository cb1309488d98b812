"""Text functions as columns. All stay in generated code; null text gives null unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The noise patterns, in the order in which they are removed.
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
NOISE = {
    "footer": r"(?i)\bSubmitted\s*:[^\n]*",
    "stamp": rf"(?i)\b(?:(?:{MONTH})\s+\d{{1,2}}(?:\s*,\s*\d{{4}})?\s*,?\s+\d{{1,2}}:\d{{2}}:\d{{2}}\s*(?:AM|PM)?\s*(?:UTC|GMT|PST|PHT|HKT|GMT[+-]\d+|UTC[+-]\d+)?"
    r"|\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:UTC|GMT|PST|PHT|HKT)?)\b",
    "see_more": r"(?i)\.{3,}\s*See\s*more\b",
    "url": r"(?i)https?://\S+|www\.\S+|\b\S+\.(?:com|net|org|ph|edu)(?:/\S*)?",
    "email": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "phone": r"(?:\+?63|0)9\d{2}[-\s]?\d{3}[-\s]?\d{4}|\(0?2\)\s*\d{3,4}[-\s]?\d{4}",
    "number": r"(?U)(?<!\w)\d{4,}(?!\w)",
    "hashtag": r"(?U)#\w+",
}
REPEAT = r"(.)\1{3,}"
TRAILING_DOTS = r"\s*\.{3,}\s*$"
PLACEHOLDER = r"\[[A-Z][A-Z0-9_]*\]"
TITLE_NAME = r"\b(?:Sir|Ma'?am|Prof(?:essor)?|Dr|Engr|Atty)\.?\s+[A-Z][\p{L}]+(?:\s+[A-Z][\p{L}]+){0,2}"
DEPARTMENT = r"(?i)\b(?:Department|College|School|Institute) of [A-Z][\w\s&-]{1,40}"
PURE_MEDIA = r"(?i)^\s*(?:\[photo\]|\[video\]|\[image\]|\[REDACTED_NAME\])?\s*$"
LAZY_LABEL = r"(?i)^(?:general(?:\s+\w+)?|various(?:\s+\w+)?|misc(?:ellaneous)?(?:\s+\w+)?|other(?:\s+\w+)?|topic\s*\d+|noise|miscellaneous topics?|assorted)\s*$"
LAZY_PHRASES = [
    "general discussion", "various topics", "miscellaneous", "miscellaneous topics", "general topics", "other topics", "assorted topics", "mixed topics",
    "no theme", "untitled", "general", "various", "miscellaneous discussion",
]
IRREGULAR = {"children": "child", "men": "man", "women": "woman", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose"}


def squeeze(col: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def strip(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def noise_clean(col: Column) -> Column:
    """Without footers, machine stamps, links, addresses, numbers and tags; repeats cut to three; white space squeezed."""
    bare = reduce(lambda c, p: F.regexp_replace(c, p, ""), NOISE.values(), col)
    return squeeze(F.regexp_replace(collapse_repeats(bare), TRAILING_DOTS, ""))


def collapse_repeats(col: Column) -> Column:
    """Four or more of a character become three."""
    return F.regexp_replace(col, REPEAT, "$1$1$1")


def collapse_tags(col: Column) -> Column:
    """A tag in square brackets that repeats itself becomes one."""
    return F.regexp_replace(col, r"(\[[^\]]+\])(?:\s+\1)+", "$1")


def content_id(col: Column) -> Column:
    """The first 16 hex digits of the hash of the stripped, lower-cased text."""
    return F.substring(F.sha2(F.lower(F.trim(col)), 256), 1, 16)


def strip_placeholders(col: Column) -> Column:
    return squeeze(F.regexp_replace(col, PLACEHOLDER, " "))


def replace_rules(col: Column, rules: list[tuple[str, str]]) -> Column:
    """A left fold of (pattern, replacement) rules: each sees the text that the rules before it left."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, col)


def acronym_pattern(word: str, case_sensitive: bool = True) -> str:
    """A whole word that is no part of a hashtag."""
    return ("" if case_sensitive else "(?i)") + rf"(?U)(?<![#\w]){word}(?!\w)"


def redact_titles(col: Column, tag: str = "[REDACTED_NAME]") -> Column:
    return F.regexp_replace(col, TITLE_NAME, tag)


def redact_departments(col: Column, acronyms: list[str], tag: str = "[DEPARTMENT]") -> Column:
    longest = sorted(acronyms, key=lambda a: (-len(a), a))
    return F.regexp_replace(F.regexp_replace(col, DEPARTMENT, tag), rf"(?U)(?<![#\w])(?:{'|'.join(longest)})(?!\w)", tag)


def any_word(words: list[str], any_case: bool = True) -> str:
    """A pattern of whole words of a list, the longest first, their signs literal."""
    return ("(?i)" if any_case else "") + rf"\b(?:{'|'.join(re.escape(w) for w in sorted(words, key=lambda a: (-len(a), a)))})\b"


def redact_words(col: Column, words: list[str], tag: str = "[REDACTED]", any_case: bool = True) -> Column:
    """Whole words of a list (as written, unless ``any_case``) as a tag; runs of the tag become one."""
    return collapse_tags(F.regexp_replace(col, any_word(words, any_case), tag)) if words else col


def count_matches(col: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(pattern)), F.lit(0))


def tail(col: Column, n: int, suffix: str) -> Column:
    """The last n characters and a suffix, where the text is longer than n (the result may be longer than n by the suffix)."""
    return F.when(F.length(col) > n, F.concat(F.right(col, F.lit(n)), F.lit(suffix))).otherwise(col)


def head(col: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n)), F.lit(mark))).otherwise(col)


def words(col: Column, pattern: str = "[a-z']+") -> Column:
    """The matches of a pattern in the lower-cased text; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def singular(w: Column) -> Column:
    """The singular of an English plural, by suffix."""
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return (
        F.when(F.length(w) < 4, w)
        .when(F.try_element_at(irregular, w).isNotNull(), F.try_element_at(irregular, w))
        .when(w.endswith("ies") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(sses|ches|shes|xes)$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[^sui]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def chart_terms(col: Column, stop: list[str]) -> Column:
    """Terms for charts: no tags or links, letters and figures only, three characters or more, no stop words, singular."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)\[[A-Z_]+\]", " "), r"https?://\S+", " ")
    plain = F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}\s']", " "), "'", "")
    stops = F.array(*[F.lit(s) for s in stop])
    fit = lambda w: (F.length(w) >= 3) & ~F.array_contains(stops, w)
    first = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: fit(w) & ~w.rlike(r"^\d+$"))
    return F.filter(F.transform(first, singular), fit)


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n words; the whole text where it has fewer; none where it has no words."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def is_lazy(label: Column) -> Column:
    s = F.trim(F.coalesce(label, F.lit("")))
    return (s == "") | s.rlike(LAZY_LABEL) | F.lower(s).isin(LAZY_PHRASES)


def unquote(col: Column, depth: int = 4) -> Column:
    """Without quotes of any kind around the whole text, up to ``depth`` layers."""
    return reduce(lambda c, _: F.regexp_replace(F.trim(c), "(?s)^[\"'“”‘’](.*)[\"'“”‘’]$", "$1"), range(depth), col)


def first_words(col: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(col), r"\s+"), 1, n), " ")


def form_fields(col: Column) -> Column:
    """A URL-encoded form as a map."""
    return F.transform_values(F.str_to_map(col, F.lit("&"), F.lit("=")), lambda _, v: F.url_decode(v))


def noise_lines(col: Column, patterns: list[str]) -> Column:
    """The lines that match none of the patterns, joined again."""
    kept = F.filter(F.split(col, "\n"), lambda line: ~reduce(lambda a, p: a | line.rlike(p), patterns, F.trim(line) == ""))
    return F.array_join(kept, "\n")


def longest_block(col: Column, patterns: list[str], least: int = 6) -> Column:
    """Of the lines that match no pattern, joined where they follow each other, the longest block; null under ``least``
    characters. Blank lines count as noise."""
    kept = F.transform(F.filter(F.split(col, "\n"), lambda line: ~reduce(lambda a, p: a | F.trim(line).rlike(p), patterns, strip(line) == "")), strip)
    block = F.array_join(kept, "\n")
    return F.when(F.length(block) >= least, block)


def escape_html(col: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), col)


def highlight_tags(col: Column) -> Column:
    """Tags such as [REDACTED_NAME] inside marks for display."""
    return F.regexp_replace(col, r"(\[REDACTED_[A-Z_]+\])", "<mark>$1</mark>")
