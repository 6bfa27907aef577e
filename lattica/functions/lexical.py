"""English full-text matching: stemming, a web-style query language and cover-density ranking.

Texts are matched in Arrow batches; a substring test on the query's stems, done natively, leaves out most rows first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.fusion import CHANNEL, top_ranked

#: The public Snowball stop list for English.
STOP = set(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now""".split()
)
#: The weight of a lexeme without a label.
WEIGHT = 0.1
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words that the algorithm names, and its suffixes with what replaces them.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]


def _region(w: str, start: int) -> int:
    """Where what follows the first non-vowel after a vowel begins."""
    m = re.compile(rf"[{_V}][^{_V}]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]\Z", w) or re.fullmatch(rf"[{_V}][^{_V}]", w))


@lru_cache(50_000)
def stem(word: str) -> str:
    """The public English Snowball stemmer (Porter 2)."""
    w = word.lower().replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return w
    if w in _EXCEPTIONS or w in _SAME:
        return _EXCEPTIONS.get(w, w)
    w = re.sub(rf"\Ay|(?<=[{_V}])y", "Y", w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"'s'\Z|'s\Z|'\Z", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end in ("eed", "eedly"):
                w = base + "ee" if len(base) >= r1 else w
            elif re.search(f"[{_V}]", base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP2.items():
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3.items():
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str) -> dict[str, list[int]]:
    """Stem -> positions from 1; stop words take a position but are no lexemes."""
    out: dict[str, list[int]] = {}
    for k, m in enumerate(TOKEN.finditer(text.lower()), 1):
        if m[0] not in STOP:
            out.setdefault(stem(m[0]), []).append(k)
    return out


@dataclass
class Query:
    """Alternatives of required and forbidden phrases; a phrase is (stem, distance from its first word)."""

    groups: list[tuple[list[tuple[tuple[str, int], ...]], list[tuple[tuple[str, int], ...]]]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Query:
        groups, need, ban = [], [], []
        for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
            if not minus and word.lower() == "or":
                groups.append((need, ban))
                need, ban = [], []
                continue
            tokens = [m[0] for m in TOKEN.finditer((quoted or word).lower())]
            kept = [(stem(t), k) for k, t in enumerate(tokens) if t not in STOP]
            if kept:
                phrase = tuple((s, k - kept[0][1]) for s, k in kept)
                (ban if minus else need).append(phrase)
        groups.append((need, ban))
        return cls([g for g in groups if g[0] or g[1]])

    @property
    def terms(self) -> set[str]:
        return {s for need, _ in self.groups for p in need for s, _ in p}

    def matches(self, places: dict[str, Sequence[int]]) -> bool:
        return any(all(_holds(p, places) for p in need) and not any(_holds(p, places) for p in ban) for need, ban in self.groups)


def _holds(phrase: tuple[tuple[str, int], ...], places: dict[str, Sequence[int]]) -> bool:
    sets = [{k - d for k in places.get(s, ())} for s, d in phrase]
    return bool(set.intersection(*sets))


def cover_density(query: Query, places: dict[str, list[int]]) -> float:
    """The sum over minimal covers, each the less the more other words lie within it.

    Every phrase has a sorted list of the places where it begins. For each place a cover may begin at, its earliest end is
    the latest over a group's phrases of each one's next occurrence, found by bisection; the covers are those that
    no later one lies within. So the work grows with the places, whatever lies between them.
    """
    groups = []
    for need, _ in query.groups:
        held = [sorted(set.intersection(*({k - d for k in places.get(s, ())} for s, d in p))) for p in need]
        if need and all(held):
            groups.append([(p[-1][1], at) for p, at in zip(need, held, strict=True)])
    begins = sorted({k for group in groups for _, at in group for k in at})
    words = sorted({k for s in query.terms for k in places.get(s, ())})
    total, later = 0.0, None
    for begin in reversed(begins):
        ends = []
        for group in groups:
            following = [(bisect_left(at, begin), at, width) for width, at in group]
            if all(i < len(at) for i, at, _ in following):
                ends.append(max(at[i] + width for i, at, width in following))
        if ends and (later is None or min(ends) < later):
            later = min(ends)
            inside = bisect_right(words, later) - bisect_left(words, begin)
            total += WEIGHT / (1 + (later - begin) - (inside - 1))
    return total


def ranks(text: Column, query: str) -> Column:
    """Rank of each text, null where it does not match."""
    parsed = Query.parse(query)

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            places = lexemes(t or "")
            return cover_density(parsed, places) if parsed.matches(places) else None

        return pd.Series([one(t) for t in texts], dtype="float64")

    return run(text)


def lexical_channel(df: DataFrame, query: str, n: int = CHANNEL) -> DataFrame:
    """Full-text channel for :func:`lattica.operators.search.hybrid`; blank queries find nothing."""
    parsed = Query.parse(query)
    if not parsed.groups:
        return df.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    if all(need for need, _ in parsed.groups):
        # Every group needs its stems; the first letters of a stem are in all of its words.
        some = F.lit(False)
        for need, _ in parsed.groups:
            inner = F.lit(True)
            for s in {s for p in need for s, _ in p}:
                inner = inner & F.lower("content").contains(s[: max(1, len(s) - 2)])
            some = some | inner
        df = df.where(some)
    scored = df.select("id", ranks(F.col("content"), query).alias("score")).where(F.col("score").isNotNull())
    return top_ranked(scored, F.col("score"), "id", n)
