"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows, one scan of every text.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Texts are
normalised to their words with one blank on either side, so that an automaton match is always a run of whole words; word
positions lead back to character offsets of the original text.

The automaton is held by every Python worker, so the benchmark's size is checked first: beyond ``max_pattern_bytes`` of
text it is cut into shards by a hash, each a whole automaton, and the texts are scanned once per shard; the word
intervals of the shards are merged, which gives the same result.

Defined results: null and empty texts have no words and are never contaminated; an item without words has no windows;
an item whose id is null counts for hits but is not listed; repeated items count once per id; repeated documents are
judged row by row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import durable, normalised_words, small_batches

WIDTH = 13
#: A document is contaminated from one hit word in so many.
SHARE = 20
#: Benchmark text that one automaton may hold; about 15 times as much memory.
MAX_PATTERN_BYTES = 8 << 20
#: A word before A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

INTERVALS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("hit_spans", INTERVALS),
]


def framed(words: Sequence[bytes]) -> str:
    """One character per byte, a blank around each word."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def build(items: Sequence[tuple[str | None, str | None]], width: int) -> ahocorasick.Automaton | None:
    """The automaton of all windows; each leads to its number of words and its item ids."""
    windows: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normalised_words(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            ids = windows.setdefault(framed(words[i : i + n]), (n, set()))[1]
            if item is not None:
                ids.add(item)
    if not windows:
        return None
    automaton = ahocorasick.Automaton()
    for window, (n, ids) in windows.items():
        automaton.add_word(window, (n, tuple(ids)))
    automaton.make_automaton()
    return automaton


def find(automaton: ahocorasick.Automaton | None, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word intervals [lo, hi) inside occurrences of windows, merged, and the ids of their items."""
    if automaton is None or not words:
        return [], set()
    text = framed(words)
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    at, word = 0, -1
    for end, (n, ids) in automaton.iter(text):
        word += text.count(" ", at, end + 1)  # blanks up to the match's last one: the words before it
        at = end + 1
        items.update(ids)
        found.append((word - n, word))
    return merged(found), items


def merged(intervals: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def judged(text: str | None, n_words: int, words: list[tuple[int, int]], items: set[str], share: int) -> tuple:
    hit = sum(hi - lo for lo, hi in words)
    spans = []
    if words:
        places = [m.span() for m in WORD.finditer(text)]
        spans = [{"lo": places[lo][0], "hi": places[hi - 1][1]} for lo, hi in words]
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, hit, len(items), digest, hit > 0 and share * hit >= n_words, spans


_built: dict[str, ahocorasick.Automaton | None] = {}


def scan(docs: DataFrame, items: list[tuple[str | None, str | None]], text_col: str, width: int, share: int, drop_text: bool, last: bool) -> DataFrame:
    """One pass of one automaton over every text. ``_lo_hi`` and ``_items`` hold what earlier shards found."""
    key = hashlib.sha256(repr((width, items)).encode()).hexdigest()
    held = docs.sparkSession.sparkContext.broadcast(items)  # within MAX_PATTERN_BYTES
    more = "_lattica_lo_hi" in docs.columns
    kept = [f for f in docs.schema.fields if not f.name.startswith("_") or f.name not in ("_lattica_lo_hi", "_lattica_items")]
    kept = [f for f in kept if not (drop_text and last and f.name == text_col)]
    extra = ADDED if last else [T.StructField("_lattica_lo_hi", INTERVALS), T.StructField("_lattica_items", T.ArrayType(T.StringType()))]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    pairs = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = build(held.value, width)
        automaton = _built[key]
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            before = batch.column(batch.schema.names.index("_lattica_lo_hi")).to_pylist() if more else [()] * len(texts)
            known = batch.column(batch.schema.names.index("_lattica_items")).to_pylist() if more else [()] * len(texts)
            rows = []
            for text, lo_hi, ids in zip(texts, before, known, strict=True):
                words = normalised_words(text)
                got, got_items = find(automaton, words)
                if more:
                    got, got_items = merged([*got, *((x["lo"], x["hi"]) for x in lo_hi)]), got_items | set(ids)
                rows.append(judged(text, len(words), got, got_items, share) if last else ([{"lo": a, "hi": b} for a, b in got], sorted(got_items)))
            columns = [batch.column(batch.schema.names.index(n)) for n in names]
            types = [*kinds, pairs] if last else [pairs, pa.list_(pa.string())]
            columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=names + [f.name for f in extra])

    return docs.mapInArrow(run, T.StructType([*kept, *extra]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, share: int = SHARE, max_pattern_bytes: int = MAX_PATTERN_BYTES, drop_text: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (characters of the original text).

    Columns of ``docs`` with these names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*(f.name for f in ADDED))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(size) // max_pattern_bytes))
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        held = sorted(((r["item"], r["text"]) for r in part.collect()), key=str)
        docs = scan(docs, held, text_col, width, share, drop_text, k == shards - 1)
        if k < shards - 1:
            docs = durable(docs, "decontamination")
    return docs
