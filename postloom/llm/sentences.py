"""Sentence boundaries across languages and scripts.

Every line is cut at its best path through a lattice of candidate gaps: each terminator (in spaced scripts) or each
terminator or blank between words of a spaceless script is a node with log odds of ending a sentence; segments that leave
a quotation or bracket open or hold no word cost extra; the path of least cost gives the sentences.

Spaced scripts: the odds of a gap come from the terminator, the token before it (abbreviation, initial, number) and the
word after it. Spaceless scripts (Thai, Chinese, Japanese and others): whole runs are first cut into words by the best path
through a lattice of dictionary words; the gap's odds come from the word before (how often it is final, how often inside)
and the word after (how often it opens, how often it goes on), on top of what a terminator or blank says by itself. A full
stop there outweighs the words; a blank in Thai or another script without stops, and one between Chinese or Japanese
characters, is decided by them.

What words open sentences or go on after a break, which tokens are abbreviations, and the dictionary of the spaceless
scripts are counted over the whole corpus (``learn``); only entries above a fixed part of all counts are kept, which bounds
the model whatever the corpus size.

Defined results: null and blank texts have no sentences; blanks at both ends and doubled blanks never count into a
sentence; a line without letters is a sentence of its own; repeated documents get the same ends; texts are processed whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.session import materialise

# Abbreviations that never end a sentence, those that may, and words of reported speech.
NEVER_LAST = set(
    "dr dra mr mrs ms prof engr atty hon rev fr sr sra srta sgt gen col capt gng bb kgg g st sta brgy rm blk bldg dept univ avda ave blvd "
    "núm num tel pág fig vol ed vs approx aprox excl incl misc e.g i.e p.ej viz cf al डॉ श्री".split()
)
MAY_LAST = set("a.m p.m etc atbp jr inc ltd co corp ud uds ee.uu u.s u.k ph.d m.d b.s m.a hrs hr min sec kg km cm jan feb mar apr jun jul aug sept oct nov dec".split())
BEFORE_NUMBER = {"no", "nos", "núm", "blg", "pp", "p", "rm", "art", "sec"}
REPORTED = re.compile(r"(?:と|って|なんて|など|是|[^。！？]{0,8}[说說问問道喊叫答想])")

_BREAK = re.compile(r"[\n\r\u2028\u2029\u0085\u000b\u000c]")
CLOSERS = "\"'”’»›)]}」』）】》〉"
OPENERS = "\"'“‘«‹([{「『（【《〈¿¡"
_PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）"}
_BALANCED = [('"', ""), *_PAIRS.items()]
_CANDIDATE = re.compile(r"([.!?…]+|[。！？｡．।॥؟]+)")
_SPACELESS = "฀-๿຀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿"
_RUN = re.compile(f"[{_SPACELESS}]+")
_THAI_GAP = re.compile(r"(?<=[฀-໿ក-៿0-9])\s+(?=[฀-໿ក-៿])|(?<=[฀-໿ក-៿])\s+(?=[฀-໿ក-៿0-9])")
_CJK_GAP = re.compile(r"(?<=[぀-ヿ㐀-䶿一-鿿])[ \t\u00a0\u3000]+(?=[぀-ヿ㐀-䶿一-鿿])")
_STOPLESS = re.compile(r"[฀-໿ក-៿]")
_NEXT = re.compile(r"\s*[" + re.escape(OPENERS) + r"\s—–-]*([^\W\d_][\w'’-]*|\d[\w.,:]*)?")
_TOKEN_EDGE = re.compile(r"[\s\"'“‘«(\[]")
_TOKEN_REST = re.compile(r"[^\s\"”»)\]]*")
_LETTER_DOTS = re.compile(r"^(?:[^\W\d_]\.)+[^\W\d_]?\.?$")
_MARKER = re.compile(r"\s*(?:\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]|[-–—•*·])\s+")
_HOST = re.compile(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|edu|gov|ph|info|io|me|es|jp|cn|in|th|example|invalid|test)\b", re.IGNORECASE)
_WORDY = re.compile(r"\w")

MAX_WORD = 8  # characters of a dictionary word
FULL_STOP, STOPLESS_BLANK, CJK_BLANK = 6.0, 2.5, -2.5  # log odds of ending a sentence, before the words have their say
OPEN, WORDLESS = 3.0, 5.0  # what a segment costs that leaves something open, or that holds no word
SAY = 2.0  # the most that the word on one side adds or takes
LONGEST = max(map(len, NEVER_LAST | MAY_LAST))
KEEP = 2e-6  # part of all counts of a kind that an entry must have to be kept


def lines(text: str) -> Iterator[tuple[int, str]]:
    """The offset and text of each line that is not blank."""
    at = 0
    for m in _BREAK.finditer(text):
        if not text[at : m.start()].isspace() and at < m.start():
            yield at, text[at : m.start()]
        at = m.end()
    if at < len(text) and not text[at:].isspace():
        yield at, text[at:]


def _cased(line: str) -> bool:
    """Whether capitals tell anything: the line has both kinds of letters and is not mostly capitals."""
    up = sum(c.isupper() for c in line)
    return up > 0 and sum(c.islower() for c in line) > up


class Gap:
    """A candidate: where the sentence would end, the terminator, the token before it and the word after it."""

    __slots__ = ("after", "begin", "blank", "closed", "end", "first", "mark", "raw", "start", "token", "word")

    def __init__(self, line: str, begin: int, end: int, quotes: int, start: int, part: int):
        """start, part: where the token before the terminator begins, and its part behind its last terminator."""
        self.mark, self.begin = line[begin:end], begin
        self.closed = False
        while end < len(line) and line[end] in CLOSERS:
            if line[end] in "\"'" and (quotes % 2 == 0 or (line[end] == "'" and end + 1 < len(line) and line[end + 1].isalpha())):
                break
            self.closed = self.closed or line[end] not in ")]}）】"
            end += 1
        self.end = end
        self.after = line[end : end + 1]
        self.blank = self.after == "" or self.after.isspace()
        m = _NEXT.match(line, end)
        self.raw = m[1] or ""
        self.word = self.raw.lower()
        self.first = line[m.start(1)] if m[1] else line[m.end() : m.end() + 1]
        self.start = start
        token = line[start:begin].lower() if begin - start <= LONGEST else ""
        # Without a blank after the sentence before, the token begins after its terminator.
        self.token = token if token in NEVER_LAST or token in MAY_LAST else line[part:begin].lower()


def gaps(line: str) -> Iterator[Gap]:
    """The candidates of a line, in time linear in its length."""
    quotes = at = start = part = 0
    for m in _CANDIDATE.finditer(line):
        quotes += line.count('"', at, m.start())
        for edge in _TOKEN_EDGE.finditer(line, at, m.start()):
            start = part = edge.end()
        at = m.start()
        yield Gap(line, m.start(), m.end(), quotes, start, part)
        part = m.end()


def observe(text: str, counts: Counter) -> None:
    """Adds what one text says about openings, goings-on, abbreviations and spaceless words to the counts."""
    for _, line in lines(text):
        marker = _MARKER.match(line)
        body = line[marker.end() :] if marker else line
        cased = _cased(body)
        if cased:
            starts = set()
            if (m := _NEXT.match(body)) and m[1] and m[1][0].isupper():
                starts.add(m.start(1))
                counts["open", m[1].lower()] += 1
            for g in gaps(body):
                if not g.blank or not g.raw or not g.raw[0].isalpha():
                    if g.mark == "." and g.token and g.after in ",;:":
                        counts["abbr", g.token] += 1
                    continue
                dots = g.mark.startswith("...") or "…" in g.mark
                if g.raw[0].islower():
                    counts["dots" if dots else "quote" if g.closed else "plain", g.word] += 1
                    if g.mark == "." and not g.closed:
                        counts["abbr", g.token] += 1
                        counts["unit", f"{g.token} {g.word}"] += 1
                elif len(g.token) > 1 and g.token not in NEVER_LAST:
                    counts["open", g.word] += 1
                    if g.mark == "." and not g.closed:
                        counts["ends", g.token] += 1
                        if g.token in MAY_LAST:
                            counts["unit_end", g.token] += 1
        for w in re.findall(r"[^\W\d_][\w'’-]*", body):
            counts["word", w.lower()] += 1
        for run in _RUN.findall(body):
            for n in range(1, MAX_WORD + 1):
                for i in range(len(run) - n + 1):
                    counts["gram", run[i : i + n]] += 1


_STOPS = set("。！？｡．।॥؟.!?…")
_MARKS = re.compile(r"[^\w\n]*")


def observe_places(text: str, words, counts: Counter) -> None:
    """Adds where the words of spaceless runs stand: last or first in what is surely a sentence, or inside a run. A blank in
    a script without stops counts as an end."""
    for _, line in lines(text):
        for m in _RUN.finditer(line):
            own = words(m[0])
            for w in own[:-1]:
                counts["inner", w] += 1
            for w in own[1:]:
                counts["later", w] += 1
            between = _MARKS.match(line, m.end())[0]
            stopless = _STOPLESS.match(m[0])
            if m.end() + len(between) == len(line) or _STOPS & set(between) or (stopless and between.isspace()):
                counts["final", own[-1]] += 1
            back = m.start()
            while back and not line[back - 1].isalnum() and line[back - 1] not in _STOPS:
                back -= 1
            if not back or line[back - 1] in _STOPS or (stopless and line[back : m.start()].isspace()):
                counts["initial", own[0]] += 1


def learn(docs: DataFrame, keep: float = KEEP) -> dict[str, dict[str, int]]:
    """The model: counts by kind, over all texts of docs. Entries under the part ``keep`` of their kind are left out, so at
    most 1 / keep entries of a kind can reach the driver."""

    texts = docs.where("text IS NOT NULL AND text <> ''").select("text")
    model = _counted(texts, lambda t, counts, _: observe(t, counts), None, keep)
    grams = model.get("gram", {})
    if grams:
        # A gram that a longer gram explains wholly is no word of its own.
        inner = {s for g, n in grams.items() if len(g) > 1 for s in (g[:-1], g[1:]) if grams.get(s) == n}
        model["gram"] = {g: n for g, n in grams.items() if g not in inner or len(g) == 1}
        spaceless = texts.where(F.col("text").rlike(f"[{_SPACELESS}]"))
        model |= _counted(spaceless, lambda t, counts, s: observe_places(t, s.words, counts), {"gram": model["gram"]}, keep)
    return model


def _counted(texts: DataFrame, add, model: dict | None, keep: float) -> dict[str, dict[str, int]]:
    """Sums of what ``add`` (text, counts, splitter by the model so far) counts in each text, by kind and value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        splitter = Splitter(model) if model else None

        def out() -> pd.DataFrame:
            return pd.DataFrame([(k, v, n) for (k, v), n in counts.items()], columns=["kind", "v", "n"])

        for b in batches:
            for t in b["text"]:
                add(t, counts, splitter)
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    sums = materialise(texts.mapInPandas(run, "kind string, v string, n long").groupBy("kind", "v").agg(F.sum("n").alias("n")), "sentence-counts")
    totals = sums.groupBy("kind").agg(F.sum("n").alias("total"))
    kept = sums.join(F.broadcast(totals), "kind").where((F.col("n") >= 2) & (F.col("n") >= keep * F.col("total")))  # ten kinds
    got: dict[str, dict[str, int]] = {}
    for r in kept.select("kind", "v", "n").toLocalIterator():
        got.setdefault(r.kind, {})[r.v] = r.n
    return got


class Splitter:
    """Cuts texts by a learned model."""

    def __init__(self, model: dict[str, dict[str, int]]):
        self.m = {k: model.get(k, {}) for k in ("open", "word", "dots", "quote", "plain", "abbr", "ends", "unit", "unit_end", "gram", "final", "inner", "initial", "later")}
        self.n = {k: sum(v.values()) + 1 for k, v in self.m.items()}
        self.cut: dict[str, list[str]] = {}
        self.token: tuple[str, int, int, bool] = ("", 0, 0, False)
        ends, word = self.m["ends"], self.m["word"]
        #: Learned abbreviations: short tokens whose dot is mostly followed by small letters, commas or figures.
        self.learned = {t for t, n in self.m["abbr"].items() if n >= 5 and n > 3 * ends.get(t, 0) and len(t.replace(".", "")) <= 4 and t.replace(".", "").isalpha() and word.get(t, 0) <= 1.5 * (n + ends.get(t, 0))}

    def _ratio(self, word: str, kind: str) -> float:
        """Log odds that a word opens a sentence rather than goes on after this kind of break."""
        opens = (self.m["open"].get(word, 0) + 0.5) / self.n["open"]
        goes = (self.m[kind].get(word, 0) + 0.5) / self.n[kind]
        return max(-6.0, min(6.0, math.log(opens / goes)))

    def opener(self, word: str) -> bool:
        o = self.m["open"].get(word, 0)
        return o >= 3 and o >= 0.01 * self.m["word"].get(word, 0)

    def words(self, run: str) -> list[str]:
        """The most probable words of a run of a spaceless script: the best path through the lattice of dictionary words."""
        got = self.cut.get(run)
        if got is None:
            if len(self.cut) > 100_000:
                self.cut.clear()
            got = self.cut[run] = self._best_words(run)
        return got

    def _best_words(self, run: str) -> list[str]:
        grams, total = self.m["gram"], self.n["gram"]
        best: list[tuple[float, int]] = [(0.0, 0)]
        unknown = math.log(0.1 / total)
        for j in range(1, len(run) + 1):
            b = (-math.inf, j - 1)
            for i in range(max(0, j - MAX_WORD), j):
                n = grams.get(run[i:j])
                cost = math.log(n / total) if n else unknown if j - i == 1 else -math.inf
                if best[i][0] + cost > b[0]:
                    b = (best[i][0] + cost, i)
            best.append(b)
        out, j = [], len(run)
        while j:
            out.append(run[best[j][1] : j])
            j = best[j][1]
        return out[::-1]

    def _leaning(self, word: str, there: str, else_: str) -> float:
        """How much more a word stands at this edge of sentences than words do at large: log odds, 0 for unknown words."""
        rate = self.n[there] / (self.n[there] + self.n[else_])
        seen, other = self.m[there].get(word, 0), self.m[else_].get(word, 0)
        p = (seen + 2 * rate) / (seen + other + 2)
        return max(-SAY, min(SAY, math.log(p / (1 - p)) - math.log(rate / (1 - rate))))

    def _spaceless_odds(self, line: str, runs: list[tuple[int, int]], begin: int, end: int) -> float:
        """Log odds from the last word before and the first word after a gap of a spaceless script."""
        k = bisect_right(runs, (begin, begin)) - 1
        out = 0.0
        if k >= 0 and runs[k][1] <= begin and _MARKS.match(line, runs[k][1]).end() >= begin:
            out += self._leaning(self.words(line[runs[k][0] : runs[k][1]])[-1], "final", "inner")
        k = bisect_left(runs, (end, 0))
        if k < len(runs) and _MARKS.match(line, end).end() >= runs[k][0]:
            out += self._leaning(self.words(line[runs[k][0] : runs[k][1]])[0], "initial", "later")
        return out

    def odds(self, g: Gap, line: str, cased: bool, body: int, runs: list[tuple[int, int]]) -> float:
        """Log odds that a gap of a spaced script ends a sentence."""
        lower = g.raw[:1].islower()
        upper = g.raw[:1].isupper()
        if g.mark[0] in "。！？｡．।॥؟":
            if g.closed and REPORTED.match(line, g.end) and not g.after.isspace():
                return -8.0
            return -8.0 if g.after and g.after in "，、,；;と" and g.closed else FULL_STOP + self._spaceless_odds(line, runs, g.begin, g.end)
        if g.after and g.after in ",;:)]}”’»」』、，":
            return -8.0
        dots = g.mark.startswith("...") or "…" in g.mark
        if not g.blank:
            return self._tight(g, line, cased, upper)
        if not g.raw:
            # Nothing but marks before the next gap or the end: they belong to this sentence unless another script follows.
            return 5.0 if g.first and (g.first.isalpha() or g.first in OPENERS) else -8.0
        abbreviation = g.mark == "." and not g.closed and bool(g.token)
        if abbreviation:
            if g.end <= body and g.token.strip("()").isalnum():
                return -8.0  # the number of a list line
            t = g.token.lstrip("¿¡-–—/")
            t = t if t in NEVER_LAST or t in MAY_LAST else t.rpartition("-")[2]
            if t in BEFORE_NUMBER and g.raw[0].isdigit():
                return -8.0
            if len(t) == 1 and t.isalpha() and not _RUN.match(t):
                strong = self.opener(g.word) and not (len(g.word) == 1 and g.word != "i")
                return 2.0 if strong and (upper or not cased) else -6.0
            if t in NEVER_LAST:
                return -8.0
            if t in MAY_LAST or t in self.learned:
                if cased:
                    return -8.0 if lower or g.raw[0].isdigit() else 3.0 if t in MAY_LAST or self.opener(g.word) else -3.0
                goes = self.m["unit"].get(f"{t} {g.word}", 0) + 0.3
                ends = self.m["unit_end"].get(t, 0) * (self.m["open"].get(g.word, 0) + 0.5) / self.n["open"] + 0.02
                return max(-6.0, min(6.0, math.log(ends / goes)))
        if not cased:
            if dots:
                return 0.5 + self._ratio(g.word, "dots")
            if g.closed:
                return self._ratio(g.word, "quote") - 0.5
            return 4.0
        if lower:
            if dots or g.closed:
                return -8.0
            return min(2.0, self._ratio(g.word, "plain") - 1.0)
        return 4.0

    def _tight(self, g: Gap, line: str, cased: bool, upper: bool) -> float:
        """A terminator with no blank behind it."""
        nxt = g.after
        if nxt in ".!?…":
            return -8.0
        if nxt in "(“«\"「『¿¡":
            return 4.0
        if not nxt.isalnum():
            return -3.0
        if _RUN.match(nxt):
            return 4.0
        start = g.start
        for edge in _TOKEN_EDGE.finditer(line, g.begin, g.end):
            start = edge.end()
        if g.mark == ".":
            if nxt.isdigit() or self._address(line, start, g.end):
                return -8.0
            if len(g.token) < 2 and g.token.isalpha():
                return 2.0 if upper and len(g.word) > 1 and self.opener(g.word) else -6.0
            if g.token in NEVER_LAST or g.token in MAY_LAST:
                return -4.0
        if upper:
            return 4.0 if cased or self.opener(g.word) else 1.0
        if cased:
            return -4.0
        return 2.0 if self.opener(g.word) and g.token in self.m["word"] else 1.0 if g.mark != "." else -2.0

    def _address(self, line: str, start: int, end: int) -> bool:
        """Whether the token around a dot is an address or an abbreviation; remembered for all dots of the token."""
        known = self.token
        if known[0] is line and known[1] == start and end < known[2]:
            return known[3]
        stop = _TOKEN_REST.match(line, end).end()
        around = line[start:stop]
        self.token = (line, start, stop, bool(_HOST.match(around) or "@" in around or "/" in around or _LETTER_DOTS.match(around)))
        return self.token[3]

    def ends(self, text: str) -> list[int]:
        """The end of every sentence of a text, in characters from its start."""
        out: list[int] = []
        for at, line in lines(text):
            last = len(line.rstrip())
            marker = _MARKER.match(line)
            body = marker.end() if marker else 0
            cased = _cased(line)
            runs = [m.span() for m in _RUN.finditer(line)]
            nodes = [(g.end, self.odds(g, line, cased, body, runs)) for g in gaps(line) if g.end < last]
            for pattern, prior in ((_THAI_GAP, STOPLESS_BLANK), (_CJK_GAP, CJK_BLANK)) if runs else ():
                nodes += [(m.start(), prior + self._spaceless_odds(line, runs, m.start(), m.end())) for m in pattern.finditer(line) if m.start() < last]
            out += [at + e for e in self._path(line, sorted(set(n for n in nodes if n[1] > -8.0)), last)]
        return out

    @staticmethod
    def _path(line: str, nodes: list[tuple[int, float]], last: int) -> list[int]:
        """The cheapest way from the start of a line to its end over the candidate gaps.

        A segment without a word costs WORDLESS; any other costs OPEN for each kind of quotation or bracket that it leaves
        open, and passing over a gap costs its odds. What a segment leaves open follows from the balances at both its ends.
        For each choice of kinds, the best start is kept for each set of their balances; a segment from it costs at most
        OPEN for each kind not chosen, and exactly that for the right choice. So any number of gaps may be passed over, at
        a cost linear in the gaps.
        """
        if not nodes:
            return [last]
        points = [0, *(e for e, _ in nodes), last]
        gain = [0.0, *(s for _, s in nodes), 0.0]
        kinds = [(a, b) for a, b in _BALANCED if a in line or (b and b in line)]
        picks = [[k for k in range(len(kinds)) if n >> k & 1] for n in range(1 << len(kinds))]
        starts: list[dict[tuple[int, ...], tuple[float, int]]] = [{} for _ in picks]  # with a word behind them
        bare: dict[tuple[int, ...], tuple[float, int]] = {}  # by balance, without a word behind it yet
        nearest = none = (-math.inf, 0)  # the best of those
        balance = [0] * len(kinds)
        best: list[tuple[float, int]] = [(0.0, 0)]
        passed = 0.0  # what passing over all gaps so far costs
        for j in range(1, len(points)):
            start, key = (best[j - 1][0] + passed, j - 1), tuple(balance)
            bare[key] = max(start, bare.get(key, start))
            nearest = max(nearest, start)
            piece = line[points[j - 1] : points[j]]
            for k, (a, b) in enumerate(kinds):
                balance[k] = balance[k] + piece.count(a) - piece.count(b) if b else (balance[k] + piece.count(a)) % 2
            if _WORDY.search(piece):
                for key, start in bare.items():
                    for pick, known in zip(picks, starts, strict=True):
                        at = tuple([key[k] for k in pick])
                        known[at] = max(start, known.get(at, start))
                bare.clear()
                nearest = none
            value, i = nearest
            found = (value - WORDLESS, i)
            for pick, known in zip(picks, starts, strict=True):
                value, i = known.get(tuple([balance[k] for k in pick]), none)
                found = max(found, (value - OPEN * (len(kinds) - len(pick)), i))
            best.append((found[0] + gain[j] - passed, found[1]))
            passed += max(0.0, gain[j])
        out, j = [], len(points) - 1
        while j:
            out.append(points[j])
            j = best[j][1]
        return out[::-1]


def sentence_ends(docs: DataFrame, model: dict[str, dict[str, int]]) -> DataFrame:
    """doc_id, sentence_no (1-based) and end_pos of every sentence of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Splitter(model)
        for b in batches:
            ids, no, ends = [], [], []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                e = s.ends(t)
                ids += [d] * len(e)
                no += range(1, len(e) + 1)
                ends += e
            if ids:
                yield pd.DataFrame({"doc_id": ids, "sentence_no": no, "end_pos": ends})

    return docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text").mapInPandas(run, "doc_id long, sentence_no long, end_pos long")
