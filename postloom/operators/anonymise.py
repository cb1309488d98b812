"""Anonymising by an ordered rule table.

Schools are described in YAML (names, hashtag pattern, location markers, cheers, acronym and its flags); ``rule_table`` makes
one ordered list of rules from them: tags, names, locations, cheers, ambiguous cheers, acronyms, the longest first inside
each pass. ``anonymised`` is the left fold of the rules over a text: each rule sees what those before it left. Which rules
matched, and whose regions they name, comes out beside the text. Texts that no rule can touch (the most) are found by one
pattern and skip the fold.

Defined results: null stays null with no labels; an empty table of rules changes nothing; special signs in names are
literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class School:
    acronym: str
    region: str
    hashtag: str
    names: list[str] = field(default_factory=list)
    markers: list[tuple[str, bool]] = field(default_factory=list)  # phrase, and whether the region stands in for it
    cheers: list[str] = field(default_factory=list)
    skip_acronym: bool = False
    case_sensitive: bool = False

    @property
    def tag(self) -> str:
        return f"[{self.region}]"


@dataclass(frozen=True)
class Rule:
    kind: str  # tag (a pattern), phrase or acronym (literal)
    what: str
    to: str
    label: str
    region: str | None
    any_case: bool

    @property
    def pattern(self) -> str:
        if self.kind == "tag":
            return self.what
        before = r"(?<![#\w])" if self.kind == "acronym" else r"(?<!\w)"
        return ("(?iuU)" if self.any_case else "(?U)") + before + re.escape(self.what) + r"(?!\w)"


def load_schools(text: str) -> tuple[list[School], list[str]]:
    """The schools and ambiguous cheers of a YAML text."""
    import yaml

    raw = yaml.safe_load(text) or {}
    schools = [
        School(
            s["acronym"], s["region"], s["hashtag"], list(s.get("names") or []), [(m["phrase"], bool(m.get("region_stands_in", True))) for m in s.get("markers") or []],
            list(s.get("cheers") or []), bool(s.get("skip_acronym")), bool(s.get("case_sensitive")),
        )
        for s in raw.get("schools") or []
    ]
    return schools, list(raw.get("ambiguous_cheers") or [])


def rule_table(schools: list[School], ambiguous: list[str]) -> list[Rule]:
    """The ordered rules. Ambiguous cheers are dropped from the text and name no region."""
    longest = lambda rules: sorted(rules, key=lambda r: -len(r.what))  # noqa: E731  (stable)
    unsure = {a.lower() for a in ambiguous}
    return [
        *(Rule("tag", s.hashtag, "", f"tag:{s.acronym}", s.region, False) for s in schools),
        *longest([Rule("phrase", n, s.tag, f"name:{s.acronym}", s.region, True) for s in schools for n in s.names]),
        *longest([Rule("phrase", p, s.tag if stands else "", f"place:{s.acronym}", s.region, True) for s in schools for p, stands in s.markers]),
        *longest([Rule("phrase", c, s.tag, f"cheer:{s.acronym}", s.region, True) for s in schools for c in s.cheers if c.lower() not in unsure]),
        *(Rule("phrase", a, "", f"ambiguous:{a}", None, True) for a in ambiguous),
        *longest([Rule("acronym", s.acronym, s.tag, f"acronym:{s.acronym}", s.region, not s.case_sensitive) for s in schools if not s.skip_acronym]),
    ]


def anonymised(col: Column, rules: list[Rule]) -> Column:
    """A struct of ``text``, ``labels`` (of the rules that matched, in their order) and ``regions`` (distinct, sorted)."""
    none = F.array().cast("array<string>")
    plain = F.struct(col.alias("text"), none.alias("labels"), none.alias("regions"))
    if not rules:
        return plain
    given = F.array(*[F.struct(F.lit(r.pattern).alias("p"), F.lit(r.to).alias("to"), F.lit(r.label).alias("label"), F.lit(r.region).alias("region")) for r in rules])
    hit = lambda x, r: F.regexp_like(x["text"], r["p"])

    def step(x: Column, r: Column) -> Column:
        more = lambda c: F.when(hit(x, r), F.array_append(x[f"{c}s"], r[c])).otherwise(x[f"{c}s"]).alias(f"{c}s")
        return F.struct(F.regexp_replace(x["text"], r["p"], r["to"]).alias("text"), more("label"), more("region"))

    done = F.aggregate(given, F.struct(col.alias("text"), none.alias("labels"), none.alias("regions")), step)
    out = F.struct(done["text"].alias("text"), done["labels"].alias("labels"), F.array_sort(F.array_distinct(F.array_compact(done["regions"]))).alias("regions"))
    any_of = "|".join(f"(?:{r.pattern})" for r in rules)
    return F.when(col.rlike(any_of), out).otherwise(plain)


def masked(col: Column, tag: str = r"\[[A-Z][A-Z0-9_]*\]") -> tuple[Column, Column]:
    """A text with its tags as private signs, so that a tagger does not take them for names, and the tags in order."""
    return F.regexp_replace(col, tag, "\ue000"), F.regexp_extract_all(col, F.lit(f"({tag})"), F.lit(1))


def unmasked(col: Column, tags: Column) -> Column:
    """The tags back in their places; a sign without a tag goes."""
    parts = F.split(col, "\ue000")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(parts) - 1, F.coalesce(F.get(tags, i), F.lit(""))).otherwise(""))), "")
