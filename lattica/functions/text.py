"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generational suffixes of person names, first-person forms, and what is stripped around them.
SUFFIXES = ["jr", "sr", "jnr", "snr", "ii", "iii", "iv", "v"]
FIRST_PERSON = ["i", "me", "my", "mine", "myself", "the user", "we", "us", "our", "ours", "ourselves"]
EDGE_PUNCTUATION = ".,!?;:\"'"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """The set of three-letter runs of each word, padded by two blanks before and one after it."""
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words(text), of_word)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)).cast("float")


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def folded(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def light(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def snippet(text: Column, length: int) -> Column:
    """At most ``length`` characters, with an ellipsis for what is cut."""
    t = stripped(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, length), r"\s+$", ""), F.lit("…")))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def excerpt(text: Column, query: str, length: int = 200) -> Column:
    """HTML-escaped, with the first match of ``query`` marked; long texts are cut to a window around it, or to their start."""
    t = F.coalesce(text, F.lit(""))
    n, half = len(query), max(0, (length - len(query)) // 2)
    at = (F.locate(query.lower(), F.lower(t)) if query else F.lit(0)) - 1
    long = F.length(t) > length
    start = F.when(long, F.greatest(at - half, F.lit(0))).otherwise(F.lit(0))
    end = F.when(long, F.least(at + n + half, F.length(t))).otherwise(F.length(t))
    part = lambda a, b: escaped(F.substring(t, a + 1, F.greatest(b - a, F.lit(0))))
    dots = lambda cut: F.when(cut, "…").otherwise("")
    hit = F.concat(dots(start > 0), part(start, at), F.lit("<mark>"), part(at, at + n), F.lit("</mark>"), part(at + n, end), dots(end < F.length(t)))
    return F.when(at >= 0, hit).when(long, F.concat(part(F.lit(0), F.lit(length)), F.lit("…"))).otherwise(escaped(t))


def is_first_person(surface: Column) -> Column:
    bare = F.regexp_replace(F.lower(stripped(F.coalesce(surface, F.lit("")))), f"^[{EDGE_PUNCTUATION}]+|[{EDGE_PUNCTUATION}]+$", "")
    return stripped(bare).isin(FIRST_PERSON)


def iso_z(ts: Column) -> Column:
    """Milliseconds, cut, not rounded."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def recency(ts: Column, now: Column) -> Column:
    """now, {m}m, {h}h or {d}d; what lies ahead is now."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    of = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "now").when(seconds < 3600, of(60, "m")).when(seconds < 86400, of(3600, "h")).otherwise(of(86400, "d"))


#: Day buckets in the order in which they are shown.
BUCKETS = ["today", "yesterday", "this-week", "earlier"]


def day_bucket(ts: Column, now: Column) -> Column:
    """Future times count as today, unknown ones as earlier; weeks begin on Monday."""
    day, today = F.to_date(ts), F.to_date(now)
    return F.when(day >= today, "today").when(day == F.date_sub(today, 1), "yesterday").when(day >= F.to_date(F.date_trunc("week", today)), "this-week").otherwise("earlier")


def actor(created_by: Column) -> Column:
    return F.when(created_by.startswith("consolidation"), "auto").when(created_by.startswith("ui-session:") | created_by.startswith("mcp:"), "human").otherwise("system")


def change_type(target_kind: Column, before: Column, after: Column) -> Column:
    """What an audit row did, from the keys of its JSON documents."""
    keys = F.array_union(F.coalesce(F.json_object_keys(before), F.array().cast("array<string>")), F.coalesce(F.json_object_keys(after), F.array().cast("array<string>")))
    has = lambda k: F.array_contains(keys, k)
    entity = (
        F.when(has("merged_into"), F.when(F.get_json_object(after, "$.merged_into").isNull(), "unmerge").otherwise("merge"))
        .when(has("experience_ids"), "split").when(has("canonical_name"), "rename").otherwise("edit")
    )
    experience = (
        F.when(has("deleted_at"), "delete").when(has("superseded_by"), "supersede")
        .when(has("visibility") & ~has("content") & ~has("metadata"), "visibility").otherwise("edit")
    )
    return F.when(target_kind == "claim", "retract").when(target_kind == "entity", entity).when(target_kind == "experience", experience).otherwise("edit")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def content_key(account: Column, data: Column) -> Column:
    return F.concat(account, F.lit("/"), F.sha2(data, 256), F.lit(".webp"))
