"""Row predicates that every read shares, as boolean columns."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def live() -> Column:
    return F.col("superseded_by").isNull() & F.col("deleted_at").isNull()


def visible(viewer: str | None) -> Column:
    """Without a viewer everything; else what is theirs or shared."""
    return F.lit(True) if viewer is None else (F.col("owner").eqNullSafe(F.lit(viewer))) | (F.col("visibility") == "shared")


def editable(viewer: str | None) -> Column:
    return F.lit(True) if viewer is None else F.col("owner").eqNullSafe(F.lit(viewer))


def since(column: str, now: Column, days: int, strict: bool = False) -> Column:
    bound = now - F.make_dt_interval(F.lit(days))
    return F.col(column) > bound if strict else F.col(column) >= bound


def on_date(day: Column) -> Column:
    """It occurred that day or, if that is unknown, was captured then."""
    return (F.to_date("occurred_at") == day) | (F.col("occurred_at").isNull() & (F.to_date("captured_at") == day))


def crosses_antimeridian(min_lng: float, max_lng: float) -> bool:
    return min_lng > max_lng


def in_bbox(min_lat: float, min_lng: float, max_lat: float, max_lng: float) -> Column:
    """Null coordinates are outside; a box whose west is beyond its east wraps around."""
    lng = F.col("lng")
    across = (lng >= min_lng) | (lng <= max_lng) if crosses_antimeridian(min_lng, max_lng) else lng.between(min_lng, max_lng)
    return F.col("lat").between(min_lat, max_lat) & across


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains(column: str | Column, wanted: Any, path: str = "$") -> Column:
    """JSON containment of a fixed value, compiled into path look-ups: objects member by member, arrays as subsets."""
    col = F.col(column) if isinstance(column, str) else column
    at = F.get_json_object(col, path)
    if isinstance(wanted, Mapping):
        return all_of([at.isNotNull(), *(contains(col, v, f"{path}['{k}']" if not k.isidentifier() else f"{path}.{k}") for k, v in wanted.items())])
    if isinstance(wanted, list):
        if any(isinstance(x, (Mapping, list)) for x in wanted):
            raise ValueError("arrays of objects or arrays are not supported in a filter")
        items = F.from_json(at, "array<string>")
        return all_of([items.isNotNull(), *(F.coalesce(F.array_contains(items, _text(x)), F.lit(False)) for x in wanted)])
    if wanted is None:
        return F.coalesce(F.variant_get(F.try_parse_json(col), path, "string").isNull() & F.try_parse_json(col).isNotNull(), F.lit(False))
    return F.coalesce(at == _text(wanted), F.lit(False))


def _text(x: Any) -> str:
    return x if isinstance(x, str) else json.dumps(x)
