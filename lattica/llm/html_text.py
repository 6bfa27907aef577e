"""Main text of web pages by the recurrent block labeller.

Pages are independent: one pass, no shuffle. The labeller's weights, some hundred kilobytes, are trained once on the driver
and broadcast. Whole pages are read; within a task, pages of like length are labelled together, within a bound on blocks.

Defined results: a null or empty page, and one without article blocks, has an empty text; repeated pages are extracted
each; columns that clash with text and n_chars are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm.common import small_batches
from lattica.llm.block_labeller import Model, label, train
from lattica.llm.html_blocks import leaves

ADDED = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_article_blocks", T.LongType())]
#: Characters of html parsed at once.
CHUNK = 4_000_000

_trained: list[Model] = []


def standard_model() -> Model:
    if not _trained:
        _trained.append(train())
    return _trained[0]


def extract_text(pages: DataFrame, html_col: str = "html", model: Model | None = None, drop_html: bool = True) -> DataFrame:
    """``pages`` with text, n_chars, n_blocks and n_article_blocks."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or standard_model())
    kept = [f for f in pages.schema.fields if f.name not in {a.name for a in ADDED} and not (drop_html and f.name == html_col)]
    names = [f.name for f in kept]

    def texts(html: list[str | None]) -> list[tuple[str, int, int]]:
        blocks = [leaves(h) for h in html]
        return [("\n".join(x.text for x, k in zip(b, keep, strict=True) if k), len(b), int(keep.sum())) for b, keep in zip(blocks, label(held.value, blocks), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.names.index(html_col)).to_pylist()
            rows: list[tuple[str, int, int]] = []
            part: list[str | None] = []
            size = 0
            for h in html:
                part.append(h)
                size += len(h or "")
                if size > CHUNK:
                    rows += texts(part)
                    part, size = [], 0
            rows += texts(part)
            columns = [batch.column(batch.schema.names.index(n)) for n in names]
            columns += [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=names + [a.name for a in ADDED])

    return pages.select(*dict.fromkeys([*names, html_col])).mapInArrow(run, T.StructType([*kept, *ADDED]))
