"""Personal information in free text, found by a skip-chain conditional random field and replaced by typed placeholders.

Tokens are labelled as outside, or as begin or inside of an e-mail address, phone number, identity number, street address
or personal name. Linear-chain potentials tie neighbours; skip edges tie equal or similar rare words and equal numbers of one document,
so that what is plainly a name in one place counts as one in the other. Marginals on the loopy graph come from a few rounds
of message passing between chain and skip edges, for many documents at once.

There are no labelled texts, so weights are fitted on a bounded sample of posts (SAMPLE, drawn by hash of the id) with
labels of strict rules: full patterns, listed given names with a surname, titles, signatures. Segments in which the rules
leave capitalised pairs undecided are not used. Word shapes, endings, neighbours and pattern hits are the features;
segments with patterned data are fitted with and without their hits, so that unlisted names and unusual spellings are found
by their form and company. The weights of skip edges are fitted on the same labels. A span is what the field labels; a pattern
hit that it overlaps only makes its ends exact. The word lists behind rules and features
(words that are common, given names that stand alone) are counted over all posts.

Only segments with any sign of personal data enter the field: a cheap test that is remembered per distinct segment.

Defined results: null, blank and sign-free texts have no finds and stay as they are; spans are those of the stored text,
whatever invisible or look-alike characters stand in them; repeated rows get equal results; texts are processed whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.canonical import folded, reader_form
from postloom.session import materialise

KINDS = ["email", "phone", "id_number", "address", "name"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
L = len(LABELS)
SAMPLE, MOST_SEGMENTS, MOST_PLAIN, BUCKETS, EPOCHS = 20_000, 12_000, 1_500, 1 << 16, 12  # the first three bound the fit
WINDOW = 120  # tokens of a segment fitted at once
ROUNDS, MOST_SKIP, UNFITTED_SKIP = 2, 4.0, 1.5  # of message passing; the greatest weight of a skip edge, and that of an unfitted field

# Titles, words before a name, and marks of addresses.
TITLES = set("sir ma'am ma’am maam mam prof dr dra engr atty mr mrs ms miss dean coach gng bb fr rev hon".split())
BEFORE_NAME = set("si ni kay sina nina kina kang".split())
_STREET = r"St|Street|Road|Rd|Ave|Avenue|Avda|Calle|Subd|Subdivision|Village|Residences|Brgy|Barangay|Purok|Sitio|Blk|Block|Lot|Unit|Zone|Phase|Bldg|Drive|Lane|Highway"
_PLACE = r"(?:[A-Z][\w’'-]*\.?|\d{1,4}[A-Z]?)"
ADDRESS = re.compile(
    r"(?<![\w#-])(?:#\s?\d{1,5}(?:-?[A-Z])?|\d{1,5}(?:-?[A-Z])?(?=\s+[A-Z])|(?:Blk|Block|Lot|Unit|Purok|Sitio|Zone|Phase|Room|Rm|Bldg)\.?\s*[\w-]+)"
    rf"(?:,?\s+(?:cor\.|corner|{_PLACE}))*?,?\s+(?:{_STREET})\b\.?(?:,?\s+(?:cor\.|corner|{_PLACE}))*"
    rf"|(?<![\w#-])(?:Purok|Sitio|Zone)\s+\w+(?:,\s+(?:{_PLACE})(?:\s+{_PLACE})*)+"
)
EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+%-]*\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?[\w-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[\w-]*\w)+"
    r"|[A-Za-z0-9][\w.+%-]*\sat\s[\w-]+(?:\sdot\s[\w-]*\w)+",
    re.IGNORECASE,
)
PHONE = re.compile(
    r"(?<![\w+.-])(?:\+?63[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}|\(0\d{1,2}\)\s?\d{3,4}[\s.-]?\d{4}|0(?:[ .-]?\d){10}|\+\d{1,3}(?:[\s.-]?\(?\d{2,4}\)?){2,4})(?![\w-])"
)
ID_NUMBER = re.compile(r"(?<![\w.-])(?!(?:19|20)\d\d-(?:19|20)\d\d(?![\w-]))(?=(?:[A-Z-]*\d){6})[A-Z]{0,2}\d[\dA-Z]*(?:-[\dA-Z]+)*(?![\w-]|[.,:]\d)")
_PATTERNS = {"email": EMAIL, "phone": PHONE, "id_number": ID_NUMBER, "address": ADDRESS}

_STRETCHED = re.compile(r"(.)\1\1")
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*|\d+|[^\w\s]|_")
#: Ends of segments: terminators before a blank (a dot only after four letters or figures that are no abbreviation), line breaks.
_CUT = re.compile(r"([!?.])(?:(?<=[!?])\s+|(?<=[a-z0-9]{4}\.)(?<!Brgy\.)(?<!Subd\.)(?<!Prof\.)(?<!Engr\.)(?<!Atty\.)(?<!Bldg\.)\s+(?=[A-Z~–—-]))|\n+")
_SIGN = re.compile(
    rf"@|[(\[{{]\s?at\s?[)\]}}]|\sdot\s|\b(?:{_STREET})\b|(?:\d[A-Z-]*){{6}}|\b\d{{1,5}}[A-Z]?,?\s+[A-Z][a-z]|(?:\d[\s().-]?){{7}}|(?:\d[\s().-]{{2}}){{7}}|^\s*[~–—-]\s*[A-Z]"
    r"|\b(?:[Ss]ir|SIR|[Mm]a[’']?am|[Pp]rof|Dra?|Engr|Atty|Mr|Mrs|Ms|Dean|Gng|Bb)\b\.?\s+[A-Z]"
)
_CAPITAL = re.compile(r"(?:\b([Ss]i|[Nn]i|[Kk]ay|[Kk]ang|[Ss]ina|[Nn]ina|[Kk]ina)\s+)?\b([A-Z][^\W\d_]+)(?:,?\s+(?:[A-Z]\.\s+)?(?=([A-Z][^\W\d_]+)))?")


def segments(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _CUT.finditer(text):
        end = m.start() + (m[1] is not None)
        if end > at:
            yield at, end
        at = m.end()
    if at < len(text):
        yield at, len(text)


class Lexicon:
    """Listed given names, the words that the posts write small, and given names that often stand alone as plain words."""

    def __init__(self, given: set[str], common: set[str], alone: set[str] | None = None):
        self.given, self.common, self.alone = given, common, alone or set()

    def rare(self, word: str) -> bool:
        low = word.lower()
        # A letter three times in a row is an exclamation.
        return len(word) > 1 and word[0].isupper() and low not in self.common and low not in BEFORE_NAME and low not in TITLES and not _STRETCHED.search(low)

    def ordinary(self, word: str) -> bool:
        return word.lower() in self.common or word.lower() in self.alone

    def signs(self, segment: str) -> bool:
        """Whether a segment can hold personal data at all."""
        if _SIGN.search(segment):
            return True
        for before, word, after in _CAPITAL.findall(segment):
            if word.lower() in self.given or (before or (after and self.rare(after))) and self.rare(word):
                return True
        return False


def tokenise(segment: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(segment)]


def _shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 10)}"
    if not w[0].isalpha():
        return w
    if w.isupper():
        return "X" if len(w) == 1 else "XX"
    return "Xx" if w[0].isupper() else "x"


_HASHES: dict[str, int] = {}


def _hash(text: str) -> int:
    got = _HASHES.get(text)
    if got is None:
        if len(_HASHES) > 300_000:
            _HASHES.clear()
        got = _HASHES[text] = zlib.crc32(text.encode())
    return got


WIDTH = 13  # features of a token


def _mix(salt: int, *parts: np.ndarray) -> np.ndarray:
    x = np.full(len(parts[0]), salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for p in parts:
        x = (x ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(20)) % np.uint64(BUCKETS)


def features(segs: list[tuple[str, list[tuple[int, int, str]]]], lex: Lexicon, blind: bool = False) -> list[np.ndarray]:
    """Hashed features of the tokens of each segment: its word, form and ending, its neighbours', and the pattern hits that
    it lies in (none if ``blind``). Words are looked up one by one, the features of all tokens are mixed at once."""
    edge, end = _hash("^"), _hash("$")
    low, kind, word, three, four, hit, real = [], [], [], [], [], [], []
    for segment, tokens in segs:
        hits = [0] * len(tokens)
        for k, pattern in enumerate(() if blind else _PATTERNS.values()):
            for m in pattern.finditer(segment):
                first = True
                for i, (a, b, _) in enumerate(tokens):
                    if m.start() <= a and b <= m.end():
                        hits[i] += (1 if first else 2) * 3**k
                        first = False
        low += [edge, edge]
        kind += [edge, edge]
        for _, _, w in tokens:
            v = w.lower()
            sort = _shape(w)
            if w[0].isupper() and w[0].isalpha():
                sort += ("g" if v in lex.given else "") + ("c" if v in lex.common else "r")
            if v in TITLES:
                sort += "t"
            low.append(_hash(v))
            kind.append(_hash(sort))
            word.append(_hash(v if v in lex.common or not v.isalpha() else "?"))
            three.append(_hash(v[-3:]))
            four.append(_hash(v[-4:]))
        low += [end, end]
        kind += [end, end]
        real += [False, False, *[True] * len(tokens), False, False]
        hit += [0, 0, *hits, 0, 0]
    at = np.flatnonzero(np.array(real, bool))
    u = lambda x: np.array(x, np.uint64)
    lo, ki, hi = u(low), u(kind), u(hit)
    k1, k, m1 = ki[at - 1], ki[at], ki[at + 1]
    f = np.stack(
        [
            _mix(1, u(word)), _mix(2, k), _mix(3, u(three), k), _mix(4, u(four)), _mix(5, lo[at - 1]), _mix(6, lo[at + 1]), _mix(7, k1, k), _mix(8, k, m1), _mix(9, lo[at - 2], k1),
            _mix(10, m1, lo[at + 2]), _mix(11, k1, k, m1), _mix(12, hi[at]), _mix(13, hi[at - 1], hi[at + 1]),
        ], axis=1,
    ).astype(np.int64) if len(at) else np.zeros((0, WIDTH), np.int64)
    return np.split(f, np.cumsum([len(t) for _, t in segs])[:-1]) if segs else []


def silver(segment: str, tokens: list[tuple[int, int, str]], lex: Lexicon, company: Counter | None = None) -> list[int] | None:
    """Labels of strict rules for a segment's tokens, or None where they leave capitalised words undecided. ``company``:
    how often the words on either side of a name were seen around names; pairs in such company are names, too."""
    y = [0] * len(tokens)

    def put(kind: str, i: int, j: int) -> None:
        b = 1 + 2 * KINDS.index(kind)
        for k in range(i, j):
            y[k] = b if k == i else b + 1

    for kind in ("email", "phone", "address", "id_number"):
        for m in _PATTERNS[kind].finditer(segment):
            own = [i for i, (a, b, _) in enumerate(tokens) if m.start() <= a and b <= m.end()]
            if own and not any(y[own[0] : own[-1] + 1]):
                put(kind, own[0], own[-1] + 1)
    words = [t[2] for t in tokens]
    n = len(words)
    cap = [w[0].isalpha() and w[0].isupper() for w in words]
    rare = [lex.rare(w) for w in words]
    given = [cap[i] and words[i].lower() in lex.given for i in range(n)]
    title = [words[i].lower() in TITLES and cap[i] for i in range(n)]

    def initial(i: int) -> int:
        return 2 if i + 1 < n and len(words[i]) == 1 and cap[i] and words[i + 1] == "." else 0

    i = 0
    while i < n:
        if y[i]:
            i += 1
            continue
        if title[i]:
            j = i + 1 + (i + 1 < n and words[i + 1] == ".")
            k = j
            while k < n and rare[k] and not y[k]:
                k += 1
            if k > j:
                put("name", j, k)
                i = k
                continue
        elif given[i]:
            k = i + 1
            while k < n and (given[k] or initial(k)):
                k += initial(k) or 1
            if k < n and rare[k] and not y[k]:
                k += 1
            elif k == i + 1 and lex.ordinary(words[i]):
                if i and words[i - 1].lower() in BEFORE_NAME:
                    return None
                i += 1
                continue
            put("name", i, k)
            i = k
            continue
        elif rare[i] and i + 2 < n and words[i + 1] == "," and given[i + 2] and not (i + 3 < n and (rare[i + 3] or given[i + 3] or initial(i + 3))):
            put("name", i, i + 3)
            i += 3
            continue
        elif company is not None and rare[i] and i + 2 < n and words[i + 1] == "," and rare[i + 2] and company[_company(words, i, i + 3)] >= 3:
            put("name", i, i + 3)
            i += 3
            continue
        elif rare[i] and i + 1 < n and (rare[i + 1] or initial(i + 1)) and not y[i + 1]:
            if i and words[i - 1] in "~–—-" and i <= 2:
                k = i
                while k < n and (rare[k] or initial(k)):
                    k += initial(k) or 1
                put("name", i, k)
                i = k
                continue
            k = i
            while k < n and (rare[k] or initial(k)):
                k += initial(k) or 1
            if company is not None and company[_company(words, i, k)] >= 3 and k - i <= 5:
                put("name", i, k)
                i = k
                continue
            return None
        elif rare[i] and i and words[i - 1].lower() in BEFORE_NAME:
            return None
        i += 1
    return y


def _company(words: list[str], i: int, k: int) -> tuple[str, str]:
    """The words before and after words i to k, edges and figures as such."""
    before = words[i - 1].lower() if i else "^"
    return before, (words[k].lower() if k < len(words) else "$")


class Field:
    """Weights and inference of the field."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None, skip: np.ndarray | None = None):
        self.skip = np.full(1 + len(KINDS), UNFITTED_SKIP, np.float32) if skip is None else skip.astype(np.float32)  # outside, then each kind
        self.emit = np.zeros((BUCKETS, L), np.float32) if emit is None else emit.astype(np.float32)
        self.move = np.zeros((L, L), np.float32) if move is None else move.astype(np.float32)
        self.ban = np.zeros((L, L), np.float32)
        for i in range(L):
            for j in range(2, L, 2):  # inside follows begin or inside of its own kind only
                if i not in (j, j - 1):
                    self.ban[i, j] = -1e4
        self.start = np.where(np.arange(L) % 2 == 0, -1e4, 0).astype(np.float32)
        self.start[0] = 0

    def unary(self, feats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(f) for f in feats)
        ids = np.zeros((len(feats), t, WIDTH), np.int64)
        mask = np.zeros((len(feats), t), bool)
        for i, f in enumerate(feats):
            if len(f):
                ids[i, : len(f)] = f
                mask[i, : len(f)] = True
        self.ids = ids
        return self.emit[ids].sum(axis=2), mask

    def messages(self, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log messages of a padded batch, and the log partition."""
        b, t, _ = u.shape
        m = self.move + self.ban
        em = np.exp(m)
        fw, bw = np.zeros_like(u), np.zeros_like(u)
        fw[:, 0] = self.start + u[:, 0]
        for i in range(1, t):
            top = fw[:, i - 1].max(axis=1, keepdims=True)
            step = np.log(np.exp(fw[:, i - 1] - top) @ em + 1e-30) + top + u[:, i]
            fw[:, i] = np.where(mask[:, i, None], step, fw[:, i - 1])
        for i in range(t - 2, -1, -1):
            x = bw[:, i + 1] + u[:, i + 1]
            top = x.max(axis=1, keepdims=True)
            step = np.log(np.exp(x - top) @ em.T + 1e-30) + top
            bw[:, i] = np.where(mask[:, i + 1, None], step, 0)
        last = fw[:, -1]
        top = last.max(axis=1, keepdims=True)
        return fw, bw, (np.log(np.exp(last - top).sum(axis=1, keepdims=True)) + top)[:, 0]

    def fit(self, feats: list[np.ndarray], labels: list[list[int]], seed: int = 1, rate: float = 0.05) -> Field:
        """Stochastic gradient ascent (AdaGrad) on the log likelihood of the chains."""
        r = np.random.default_rng(seed)
        ge, gm = np.full((BUCKETS, L), 1e-3, np.float32), np.full((L, L), 1e-3, np.float32)
        by_size = np.argsort([len(f) for f in feats], kind="stable")
        blocks = [by_size[i : i + 64] for i in range(0, len(by_size), 64)]
        for _ in range(EPOCHS):
            for k in r.permutation(len(blocks)):
                block = blocks[k]
                u, mask = self.unary([feats[i] for i in block])
                fw, bw, z = self.messages(u, mask)
                p = np.exp(np.minimum(fw + bw - z[:, None, None], 0)) * mask[..., None]
                y = np.zeros(mask.shape, np.int64)
                for i, d in enumerate(block):
                    y[i, : len(labels[d])] = labels[d]
                d = -p
                np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], 2) + mask[..., None], 2)
                # expected and seen transitions
                pair = fw[:, :-1, :, None] + (self.move + self.ban)[None, None] + (u + bw)[:, 1:, None, :] - z[:, None, None, None]
                gone = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
                seen = np.zeros((L, L), np.float32)
                np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
                g = (seen - gone) / len(block)
                gm += g * g
                self.move += rate * g / np.sqrt(gm)
                flat, rows = self.ids.reshape(-1), np.repeat(d.reshape(-1, L), self.ids.shape[2], axis=0)
                used, where = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(used), L), np.float32)
                np.add.at(grad, where, rows / len(block))
                ge[used] += grad * grad
                self.emit[used] += rate * grad / np.sqrt(ge[used])
        return self

    def fit_skips(self, ties: list[list[int]]) -> Field:
        """The weights of skip edges from the kinds (0: outside) of tied tokens: the pointwise mutual information of two tied
        tokens being of one kind, smoothed and never negative, so that edges only ever draw labels together."""
        n, both = np.ones(1 + len(KINDS)), np.full(1 + len(KINDS), 0.5)
        pairs = 1.0
        for kinds in ties:
            c = np.bincount(kinds, minlength=1 + len(KINDS)).astype(float)
            t = c.sum()
            n += c * (t - 1)
            both += c * (c - 1)
            pairs += t * (t - 1)
        rate = n / n.sum()
        self.skip = np.clip(np.log((both / pairs) / (rate * rate)), 0.0, MOST_SKIP).astype(np.float32)
        return self

    def decode(self, docs: list[tuple[np.ndarray, list[bool], list[list[int]]]]) -> list[list[int]]:
        """Best labels of each document. A document is its tokens' features, which tokens begin a segment, and the groups of
        tokens tied by skip edges."""
        out: list[list[int]] = [[] for _ in docs]
        order = np.argsort([len(d[0]) for d in docs], kind="stable")
        for k in range(0, len(order), 128):
            block = [int(i) for i in order[k : k + 128] if len(docs[i][0])]
            if not block:
                continue
            u, mask = self.unary([docs[i][0] for i in block])
            for r, i in enumerate(block):
                for t, first in enumerate(docs[i][1]):
                    if first:
                        u[r, t] += self.start  # nothing goes on over a segment's edge
            extra = np.zeros_like(u)
            ties = [(r, g) for r, i in enumerate(block) for g in docs[i][2]]
            if ties:
                kind = np.repeat(np.arange(len(KINDS)), 2)
                rows = sorted({r for r, _ in ties})
                at = {r: n for n, r in enumerate(rows)}
                for _ in range(ROUNDS):
                    fw, bw, z = self.messages((u + extra)[rows], mask[rows])
                    belief = np.exp(np.minimum(fw + bw - z[:, None, None], 0))
                    new = np.zeros_like(extra)
                    for r, g in ties:
                        # What the others of a group say of a token, without what it told them itself.
                        p = belief[at[r], g] / np.maximum(np.exp(extra[r, g] - extra[r, g].max(axis=1, keepdims=True)), 1e-6)
                        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-9)
                        same = np.stack([p[:, 0], *(p[:, 1 + 2 * k] + p[:, 2 + 2 * k] for k in range(len(KINDS)))], axis=1)
                        for n, t in enumerate(g):
                            others = np.delete(same, n, axis=0)
                            m = np.log(1 + (np.exp(self.skip) - 1) * others).sum(axis=0)
                            new[r, t, 0] = m[0]
                            new[r, t, 1:] = m[1 + kind]
                    extra = new
            for r, best in enumerate(self._viterbi(u + extra, mask)):
                out[block[r]] = best
        return out

    def _viterbi(self, u: np.ndarray, mask: np.ndarray) -> list[list[int]]:
        b, t, _ = u.shape
        m = self.move + self.ban
        score, back = self.start + u[:, 0], np.zeros((b, t, L), np.int64)
        for i in range(1, t):
            x = score[:, :, None] + m[None]
            back[:, i] = x.argmax(axis=1)
            score = np.where(mask[:, i, None], x.max(axis=1) + u[:, i], score)
        out = []
        for r in range(b):
            n = int(mask[r].sum())
            y = [int(score[r].argmax())]
            for i in range(n - 1, 0, -1):
                y.append(int(back[r, i, y[-1]]))
            out.append(y[::-1])
        return out


#: Least occurrences of a word to be judged by: a number, and a part of the texts, so that verdicts don't change with their number.
TWICE, THRICE, OFTEN = (2, 1e-4), (3, 1.5e-4), (20, 1e-3)
_CAPITALISED = re.compile(r"([A-Z][^\W\d_]+(?:[’'][^\W\d_]+)?)\.?,?\s+(?:[A-Z]\.\s+)?(?=([A-Z][^\W\d_]+))")
_FOLLOWED = re.compile(r"(?<![\w@.])([A-Z][^\W\d_]+)(,?)\s+(?:[A-Z]\.\s+)?([^\W\d_]?)")
_LETTERS = re.compile(r"[^\W\d_]+")
_LINK_OR_TAG = re.compile(r"https?://\S+|#\S+")
COUNTS = ["small", "large", "near", "lone", "full"]


def _least(bound: tuple[int, float], texts: int) -> float:
    return max(bound[0], bound[1] * texts)


def count_cases(texts: list[str], listed: set[str]) -> dict[str, Counter]:
    """How often each word is written small and large, follows a listed name or title, and, of listed names, stands alone
    or before another capitalised word. Texts in the reader's form."""
    n: dict[str, Counter] = {c: Counter() for c in COUNTS}
    for t in texts:
        for w in _LETTERS.findall(EMAIL.sub(" ", _LINK_OR_TAG.sub(" ", t))):
            n["small" if w[0].islower() else "large"][w.lower()] += 1
        for m in _CAPITALISED.finditer(t):
            if m[1].lower() in listed or m[1].lower() in TITLES:
                n["near"][m[2].lower()] += 1
        for m in _FOLLOWED.finditer(t):
            if m[1].lower() in listed:
                n["full" if m[3].isupper() and not m[2] else "lone"][m[1].lower()] += 1
    return n


def make_lexicon(n: dict[str, Counter], texts: int, listed: set[str]) -> Lexicon:
    """The word lists by the counts of so many texts."""
    small, large, near, lone, full = (n[c] for c in COUNTS)
    two, three, often = _least(TWICE, texts), _least(THRICE, texts), _least(OFTEN, texts)
    common = {w for w, k in small.items() if k >= two and k >= 0.1 * large[w] and (w not in listed or k >= three)}
    # Capitalised words that are frequent and hardly ever stand behind a given name or title are places and the like.
    common |= {w for w, k in large.items() if k >= often and near[w] < 0.05 * k and w not in listed}
    return Lexicon(listed, common, {g for g, k in lone.items() if k >= three and k >= 0.25 * (k + full[g])})


def corpus_lexicon(df: DataFrame, text: str, given: set[str]) -> Lexicon:
    """The word lists by all distinct texts. Only words that reach a threshold come to the driver."""
    listed = {g.lower() for g in given}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {c: Counter() for c in COUNTS}
        total = 0

        def rows() -> pd.DataFrame:
            words = sorted(set().union(*sums.values()))
            out = pd.DataFrame({"word": [None, *words], "texts": [total, *[0] * len(words)]})
            for c in COUNTS:
                out[c] = [0, *(sums[c][w] for w in words)]
                sums[c].clear()
            return out

        for b in batches:
            total += len(b)
            for c, more in count_cases([reader_form(t) for t in b[text]], listed).items():
                sums[c].update(more)
            if sum(map(len, sums.values())) > 300_000:
                yield rows()
                total = 0
        if total:
            yield rows()

    names = ["texts", *COUNTS]
    part = df.select(text).where(F.col(text).isNotNull() & (F.col(text) != "")).distinct().mapInPandas(run, "word string, " + ", ".join(f"{c} long" for c in names))
    counts = materialise(part.groupBy("word").agg(*(F.sum(c).alias(c) for c in names)), "cases")
    first = counts.where("word IS NULL").first()
    texts = first.texts if first else 0
    reach = (F.col("small") >= _least(TWICE, texts)) | (F.col("large") >= _least(OFTEN, texts)) | (F.col("lone") >= _least(THRICE, texts))
    got = counts.where(F.col("word").isNotNull() & reach).toPandas()
    return make_lexicon({c: Counter(dict(zip(got["word"], got[c].tolist(), strict=True))) for c in COUNTS}, texts, listed)


def learn(sample: list[str], given: set[str], seed: int = 1, lex: Lexicon | None = None) -> dict:
    """The model from a bounded sample of texts and the listed given names. The word lists are those of all texts, ``lex``;
    without it the sample counts as all texts."""
    texts = [reader_form(t) for t in dict.fromkeys(sample) if t]
    if lex is None:
        listed = {g.lower() for g in given}
        lex = make_lexicon(count_cases(texts, listed), len(texts), listed)
    segs: dict[str, None] = {}
    for t in texts:
        for a, b in segments(t):
            segs[t[a:b]] = None
    work = [(s, k) for s in sorted(segs, key=lambda x: zlib.crc32(x.encode())) if (k := tokenise(s))]
    company: Counter = Counter()
    begin = 1 + 2 * KINDS.index("name")
    for s, tokens in work:
        y = silver(s, tokens, lex)
        if y is not None and begin in y:
            words = [t[2] for t in tokens]
            for i in (i for i, v in enumerate(y) if v == begin):
                k = i + 1
                while k < len(y) and y[k] == begin + 1:
                    k += 1
                company[_company(words, i, k)] += 1
    used, plain = [], []
    for s, tokens in work:
        y = silver(s, tokens, lex, company)
        if y is None:
            continue
        if any(y):
            used.append((s, tokens, y))
        elif lex.signs(s) or len(plain) < MOST_PLAIN:
            plain.append((s, tokens, y))
        if len(used) >= MOST_SEGMENTS:
            break
    # Segments with patterned data are fitted again without the pattern hits, so that the field knows such data by its form
    # and company, too.
    unseen = [x for x in used if any(v and v != begin and v != begin + 1 for v in x[2])]
    used += plain[: MOST_SEGMENTS // 2]
    feats = features([(s, t) for s, t, _ in used], lex) + features([(s, t) for s, t, _ in unseen], lex, blind=True)
    labels = [y for _, _, y in used + unseen]
    field = Field()
    if any(any(y) for y in labels):
        cut = [(f[i : i + WINDOW], y[i : i + WINDOW]) for f, y in zip(feats, labels, strict=True) for i in range(0, len(y), WINDOW)]
        field.fit([f for f, _ in cut], [y for _, y in cut], seed)
        field.fit_skips(_tied_kinds(texts, lex, company))
    return {"emit": field.emit.astype(np.float16), "move": field.move, "skip": field.skip, "given": lex.given, "common": lex.common, "alone": lex.alone, "segments": len(labels)}


def _tied_kinds(texts: list[str], lex: Lexicon, company: Counter) -> list[list[int]]:
    """The kinds that the strict rules give to the tokens of each tied group of each text."""
    out = []
    for t in texts:
        words, kinds = [], []
        for a, b in segments(t):
            s = t[a:b]
            tokens = tokenise(s)
            y = silver(s, tokens, lex, company)
            if y is not None:
                words += [w for _, _, w in tokens]
                kinds += [(v + 1) // 2 for v in y]
        out += [[kinds[i] for i in g] for g in tied(words, lex)]
    return out


def tied(tokens: list[str], lex: Lexicon) -> list[list[int]]:
    """The groups of tokens of one document that skip edges tie: equal or similar rare words, equal long numbers."""
    groups: dict[str, list[int]] = {}
    for i, w in enumerate(tokens):
        key = _tie(w, lex)
        if key:
            groups.setdefault(key, []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def _tie(w: str, lex: Lexicon) -> str | None:
    if lex.rare(w):
        return w.lower()[:5] if len(w) > 5 else w.lower()  # similar words share their first five letters
    return w if w.isdigit() and len(w) >= 4 else None


class Finder:
    """Finds the personal data of texts by a learned model."""

    def __init__(self, model: dict):
        self.lex = Lexicon(model["given"], model["common"], model["alone"])
        self.field = Field(model["emit"], model["move"], model["skip"])
        self.plain: dict[str, bool] = {}

    def _signs(self, segment: str) -> bool:
        got = self.plain.get(segment)
        if got is None:
            if len(self.plain) > 200_000:
                self.plain.clear()
            got = self.plain[segment] = self.lex.signs(segment)
        return got

    def _document(self, text: str) -> tuple[list, list, tuple, str] | None:
        pieces = [(a, b, text[a:b]) for a, b in segments(text)]
        chosen = [self._signs(p[2]) for p in pieces]
        if not any(chosen):
            return None
        if not all(chosen):
            # What a segment without a sign shares with one that has any is tied to it, so it enters, too.
            rare = {k for p, c in zip(pieces, chosen, strict=True) if c for _, _, w in tokenise(p[2]) if (k := _tie(w, self.lex))}
            if rare:
                chosen = [c or any(_tie(w, self.lex) in rare for _, _, w in tokenise(p[2])) for p, c in zip(pieces, chosen, strict=True)]
        tokens, segs, first = [], [], []
        for (a, _, s), c in zip(pieces, chosen, strict=True):
            if c:
                own = tokenise(s)
                segs.append((s, own))
                first += [i == 0 for i in range(len(own))]
                tokens += [(a + x, a + y, w) for x, y, w in own]
        if not tokens:
            return None
        return tokens, segs, (first, tied([w for _, _, w in tokens], self.lex)), text

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(begin, end, kind) in the stored text of every piece found, for each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        docs, whose = [], []
        for i, t in enumerate(texts):
            read, begin, end = folded(t)
            d = self._document(read)
            if d:
                docs.append(d)
                whose.append((i, begin, end))
        feats = iter(features([s for d in docs for s in d[1]], self.lex))
        graphs = [(np.concatenate([next(feats) for _ in d[1]]), *d[2]) for d in docs]
        for (tokens, _, _, read), (i, begin, end), y in zip(docs, whose, self.field.decode(graphs), strict=True):
            for a, b, kind in self._spans(read, tokens, y):
                out[i].append((a, b, kind) if begin is None else (begin[a], end[b - 1], kind))
        return out

    def _spans(self, text: str, tokens: list[tuple[int, int, str]], y: list[int]) -> Iterator[tuple[int, int, str]]:
        i = 0
        while i < len(y):
            if y[i] == 0:
                i += 1
                continue
            kind = KINDS[(y[i] - 1) // 2]
            j = i + 1
            while j < len(y) and y[j] == y[i] + (y[i] % 2):
                j += 1
            got = self._exact(text, tokens[i:j], kind)
            if got:
                yield (*got, kind)
            i = j

    def _exact(self, text: str, tokens: list[tuple[int, int, str]], kind: str) -> tuple[int, int] | None:
        """The span cut to what its kind allows: a pattern hit that it overlaps gives its exact ends, else the tokens as
        labelled if they can be of that kind at all; of a name the capitalised words."""
        a, b = tokens[0][0], tokens[-1][1]
        if kind != "name":
            lo, hi = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            line = text[lo : len(text) if hi < 0 else hi]
            hits = [m for m in _PATTERNS[kind].finditer(line) if m.start() + lo < b and m.end() + lo > a]
            if not hits:
                return self._labelled(text, a, b, kind)
            m = max(hits, key=lambda m: min(m.end() + lo, b) - max(m.start() + lo, a))
            s = m[0].rstrip(" ,;")
            if kind == "address" and s.endswith(".") and not re.search(r"(?:St|Ave|Rd|Subd|Brgy|Blk|Bldg|Avda)\.$", s):
                s = s[:-1]
            return m.start() + lo, m.start() + lo + len(s)
        own = list(tokens)
        while own and (not own[0][2][0].isalpha() or own[0][2].lower() in TITLES or not own[0][2][0].isupper()):
            own.pop(0)
        while own and not (own[-1][2][0].isalpha() and own[-1][2][0].isupper() or own[-1][2] == "." and len(own) > 2 and len(own[-2][2]) == 1):
            own.pop()
        return (own[0][0], own[-1][1]) if own and len(own[0][2]) > 1 else None


    @staticmethod
    def _labelled(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
        """A labelled span that no pattern knows, without the marks around it, if it holds what its kind can't be without."""
        s = text[a:b].strip(" ,;.:!?-–—()[]\"'")
        a = text.index(s, a) if s else a
        digits = sum(c.isdigit() for c in s)
        fit = {"email": ("@" in s or " at " in s.lower()) and len(s) > 5, "phone": 7 <= digits <= 15, "id_number": 6 <= digits and len(s) <= 2 * digits, "address": digits > 0 and " " in s and any(c.isupper() for c in s)}
        if not fit[kind]:
            return None
        return (a - 1 if kind == "phone" and a and text[a - 1] in "+(" else a), a + len(s)


def find_personal(df: DataFrame, model: dict, id_col: str, text: str) -> DataFrame:
    """id, kind, found_text, begin and end (characters) of every piece of personal data."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(model)
        for b in batches:
            for k in range(0, len(b), 2048):
                part = b.iloc[k : k + 2048]
                codes, values = pd.factorize(part[text])
                found = f.find(list(values))
                rows = [(i, s, values[c][x:y], x, y) for i, c in zip(part[id_col], codes, strict=True) if c >= 0 for x, y, s in found[c]]
                if rows:
                    yield pd.DataFrame(rows, columns=[id_col, "kind", "found_text", "begin", "end"])

    return df.where(F.col(text).isNotNull()).select(id_col, text).mapInPandas(run, f"{id_col} {kind}, kind string, found_text string, begin int, end int")


def redact(df: DataFrame, model: dict, id_col: str, text: str) -> DataFrame:
    """id, the text with each piece replaced by a placeholder of its kind, such as [EMAIL], and n_found; null stays null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(model)
        for b in batches:
            codes, values = pd.factorize(b[text])
            done = []
            for v, spans in zip(values, f.find(list(values)), strict=True):
                for x, y, s in sorted(spans, reverse=True):
                    v = f"{v[:x]}[{s.upper()}]{v[y:]}"
                done.append((v, len(spans)))
            rows = [done[c] if c >= 0 else (None, 0) for c in codes]
            yield pd.DataFrame({id_col: b[id_col], "redacted_text": [r[0] for r in rows], "n_found": [r[1] for r in rows]})

    return df.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, redacted_text string, n_found int")


def draw_sample(df: DataFrame, id_col: str, text: str, most: int = SAMPLE) -> list[str]:
    """At most ``most`` texts, drawn by hash of the id."""
    rows = df.where(F.col(text).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(17)), id_col).limit(most).select(text)
    return [r[0] for r in rows.collect()]
