"""Token counts by offset-mapped attribution.

A document is its fields joined by ``joiner``, encoded once as a whole, so that counts are those of training rather than
of the parts alone. Token spans are then joined to section spans: both are sorted and gapless, so the interval join is a
binary search of token starts in section starts. Offsets are exact although byte-level tokens may end inside a
character: the join runs on UTF-8 bytes, in which section borders fall between characters.

A token that crosses a border goes, by ``rule``, to the section of its first byte (``start``), of its last byte
(``end``), or of most of its bytes, the earlier in a tie (``most``). The joiner and a line's own line feed belong to the
section that they end. So the counts of a document's sections always add up to its tokens.

Defined results: a null field is an empty section; a document of nothing but empty fields has only joiner tokens; rows
repeat if they repeat in the input; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm.common import small_batches
from lattica.llm.tokens import Encoder, default_folder, encoder, starts

ADDED = [T.StructField("n_tokens", T.LongType()), T.StructField("n_sections", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("section_tokens", T.ArrayType(T.LongType())), T.StructField("section_starts", T.ArrayType(T.LongType()))]
#: A line with the line feed that ends it.
LINE = re.compile(r"[^\n]*\n|[^\n]+")
RULES = ("start", "end", "most")


def sections(fields: Sequence[str | None], joiner: str, lines: bool) -> list[str]:
    """The document's text, cut into sections that leave nothing out."""
    parts = [(f or "") + joiner for f in fields]
    if parts:
        parts[-1] = fields[-1] or ""
    if not lines:
        return parts
    return [x for p in parts for x in LINE.findall(p) or [""]]


def attribute(enc: Encoder, parts: Sequence[str], rule: str) -> tuple[int, int, np.ndarray]:
    """All tokens, those that cross a border, and the tokens of each section."""
    text = "".join(parts)
    sizes = enc.sizes[np.frombuffer(enc.ids(text), "<u4")]
    begin = starts(sizes)
    last = begin + sizes - 1
    borders = starts([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in parts])
    # Empty sections share their start with the next one; the search from the right finds the last of these.
    of_first, of_last = (np.searchsorted(borders, x, "right") - 1 for x in (begin, last))
    crossing = of_first != of_last
    chosen = of_last if rule == "end" else of_first
    if rule == "most":
        for k in np.flatnonzero(crossing):
            inner = [*borders[of_first[k] + 1 : of_last[k] + 1], last[k] + 1]
            chosen[k] = of_first[k] + int(np.argmax(np.diff([begin[k], *inner])))
    return len(sizes), int(crossing.sum()), np.bincount(chosen, minlength=len(parts))


def token_counts(docs: DataFrame, fields: Sequence[str] = ("text",), joiner: str = "\n", lines: bool = True, rule: str = "start", tokenizer_folder: str | None = None, drop_fields: bool = False) -> DataFrame:
    """``docs`` with n_tokens, n_sections, n_crossing, section_tokens and section_starts (characters).

    Sections are the fields, or with ``lines`` the lines of each field. ``tokenizer_folder`` must exist on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    fields, folder = list(fields), tokenizer_folder or default_folder()
    docs = docs.drop(*(f.name for f in ADDED))
    kept = [f for f in docs.schema.fields if not (drop_fields and f.name in fields)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            at = batch.schema.names
            counts: list[tuple] = []
            for values in zip(*(batch.column(at.index(f)).to_pylist() for f in fields), strict=True):
                parts = sections(values, joiner, lines)
                n, crossing, each = attribute(enc, parts, rule)
                counts.append((n, len(parts), crossing, each, starts([len(p) for p in parts])))
            columns = [batch.column(at.index(n)) for n in names]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            columns += [pa.array([c[i] for c in counts], pa.list_(pa.int64())) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays(columns, names=names + [f.name for f in ADDED])

    return docs.mapInArrow(run, T.StructType([*kept, *ADDED]))
