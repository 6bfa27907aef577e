"""Parsing what callers and extractors send: JSON in prose, lists, limits."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of a capture's metadata.
MAX_BYTES, MAX_DEPTH = 16 * 1024, 6


def first_json_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text; braces inside strings do not count."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
            if isinstance(found, dict):
                return text[at:end]
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def first_json_object_udf(text: pd.Series) -> pd.Series:
    return text.map(first_json_object)


def depth(value: Any) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + max(map(depth, inner), default=0) if isinstance(value, (dict, list)) else 0


@F.pandas_udf(T.IntegerType())
def json_depth_udf(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> int | None:
        try:
            return depth(json.loads(t)) if t is not None else None
        except ValueError:
            return None

    return pd.Series([one(t) for t in text], dtype="Int32")


def acceptable_metadata(column: Column) -> Column:
    """Readable, not too large, not too deep."""
    return (F.octet_length(column) <= MAX_BYTES) & F.coalesce(json_depth_udf(column) <= MAX_DEPTH, F.lit(False))


def string_list(column: Column) -> Column:
    """A JSON array of strings, or a comma-separated list, trimmed, without blanks and repeats."""
    listed = F.coalesce(F.when(column.startswith("["), F.from_json(column, "array<string>")), F.split(column, ","))
    return F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def promoted_location(metadata: Column) -> tuple[Column, Column]:
    """Latitude and longitude out of metadata, 0.0 kept; both or neither."""
    read = lambda *paths: F.coalesce(*(F.get_json_object(metadata, p).try_cast("double") for p in paths))
    lat, lng = read("$.lat", "$.latitude", "$.location.lat"), read("$.lng", "$.longitude", "$.location.lng")
    inside = lat.between(-90, 90) & lng.between(-180, 180)
    return F.when(inside, lat), F.when(inside, lng)


def listed_strings(raw: str | None) -> list[str]:
    """A field that is a JSON list or a comma-separated one: its trimmed, non-blank items. Other JSON is refused."""
    text = (raw or "").strip()
    items = json.loads(text) if text.startswith("[") else text.split(",")
    return [x for x in (str(i).strip() for i in items) if x]


def participants(given: str | list | None) -> list[dict] | None:
    """People as dictionaries with a name: from a JSON list of names or of dictionaries, or from comma-separated names."""
    if isinstance(given, str):
        given = json.loads(given) if given.strip().startswith("[") else listed_strings(given)
    people = [x if isinstance(x, dict) else {"name": x} for x in given or []]
    if not all(isinstance(p.get("name"), str) and p["name"].strip() for p in people):
        raise ValueError("every person needs a name")
    return [{**p, "name": p["name"].strip()} for p in people] or None


def moment(raw: str | None) -> str | None:
    """An ISO 8601 time as it was given, or none."""
    text = (raw or "").strip()
    if text:
        datetime.fromisoformat(text)
    return text or None


def location(lat: str | None, lng: str | None) -> dict | None:
    """Both coordinates, finite and on the globe, or none of them."""
    given = [(x or "").strip() for x in (lat, lng)]
    if not any(given):
        return None
    if not all(given):
        raise ValueError("lat and lng go together")
    north, east = map(float, given)
    if not (abs(north) <= 90 and abs(east) <= 180):
        raise ValueError("lat or lng is out of range")
    return {"lat": north, "lng": east}


def intersect_in_order(first: list, *others: list) -> list:
    """Ids that are in all lists, in the order of the first."""
    sets = [set(o) for o in others]
    return [x for x in dict.fromkeys(first) if all(x in s for s in sets)]


def hashing_embedder(size: int = 64) -> Callable[[str], list[float]]:
    """A deterministic stand-in for an embedding model: signed hashed words, of length one."""
    from hashlib import blake2b

    def embed(text: str) -> list[float]:
        out = [0.0] * size
        for w in text.lower().split():
            h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "big")
            out[h % size] += 1.0 if h >> 40 & 1 else -1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out

    return embed
