"""Counts that describe a text's form, as native columns over the whole text.

Arrays that later lambdas index are made in a projection of their own: inside a lambda an expression is evaluated again
for each element. All columns made here have names that begin with ``_lattica_``, so that a caller's columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
#: Classes of characters.
SYMBOLS, UPPER, STOPS = "[#*$%&|<>]", "[A-Z\u00c0-\u00d6\u00d8-\u00de]", "[.?]"
WINDOW = 5
#: Contract counts and style counts, all longs.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STYLE = ["n_lines", "n_upper", "n_stops", "n_bangs", "n_bars", "n_single", "n_adjacent", "n_distinct"]


def named(name: str) -> str:
    return f"_lattica_{name}"


def count(name: str) -> Column:
    """One of COUNTS or STYLE of ``with_counts``."""
    return F.col(named(name))


def counted_names(style: bool = True) -> list[str]:
    return [named(n) for n in (COUNTS + STYLE if style else COUNTS)]


def settled(column: Column) -> Column:
    """The same value, computed once for each row: Spark moves a filter below a projection by copying the expressions that it
    needs, which for nested array functions multiplies them, but never below one that is not deterministic."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def occurrences(text: Column, characters: str) -> Column:
    """How many of the text's characters are in this class."""
    return F.regexp_count(text, F.lit(characters)).cast("long")


def neighbours(array: str, field: str) -> Column:
    """Elements of a sorted array of structs that agree in ``field`` with the one before or after."""
    a = F.col(array)
    return F.filter(a, lambda x, k: ((k > 0) & (F.get(a, k - 1)[field] == x[field])) | F.coalesce(F.get(a, k + 1)[field] == x[field], F.lit(False)))


def repeat_words(df: DataFrame) -> DataFrame:
    """``df`` with n_repeat_words from the words' hashes and the words.

    Hashes of windows only decide where to look: a text without two equal hashes has no two equal windows, and of
    the others only windows whose hashes meet are compared, as texts. Sorting keeps this at n log n for any text.
    """
    n = F.size("_lattica_w")
    at = lambda i: F.get(F.col("_lattica_h"), i)
    nothing = F.array().cast("array<struct<k:bigint,i:int>>")
    no_text = F.array().cast("array<struct<k:string,i:int>>")
    df = df.withColumn("_lattica_g", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_lattica_g")) < F.size("_lattica_g")
    df = df.withColumn("_lattica_s", F.when(again, F.sort_array(F.transform("_lattica_g", lambda x, i: F.struct(x.alias("k"), i.alias("i"))))).otherwise(nothing))
    df = df.withColumn("_lattica_c", F.when(F.size("_lattica_s") > 0, neighbours("_lattica_s", "k")).otherwise(nothing))
    window = lambda x: F.array_join(F.slice(F.col("_lattica_w"), x["i"] + 1, WINDOW), " ")
    df = df.withColumn("_lattica_x", F.when(F.size("_lattica_c") > 0, F.sort_array(F.transform("_lattica_c", lambda x: F.struct(window(x).alias("k"), x["i"].alias("i"))))).otherwise(no_text))
    df = df.withColumn("_lattica_p", F.when(F.size("_lattica_x") > 0, F.sort_array(F.transform(neighbours("_lattica_x", "k"), lambda x: x["i"]))).otherwise(F.array().cast("array<int>")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_lattica_p", start, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + (p + WINDOW - F.greatest(a["end"], p))).alias("n")), lambda a: a["n"])
    return df.withColumn(named("n_repeat_words"), covered)


def with_counts(docs: DataFrame, text_col: str, style: bool = True, repeats: bool = True) -> DataFrame:
    """``docs`` with COUNTS and, with ``style``, STYLE, under ``named``. A null text counts as empty.

    Without ``repeats`` n_repeat_words, which costs more than all others, is left out.
    """
    df = docs.withColumn("_lattica_t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("_lattica_w", F.array_remove(F.split(F.regexp_replace("_lattica_t", "[\\t-\\r]", " "), " "), ""))
    df = df.withColumn("_lattica_h", F.transform("_lattica_w", lambda x: F.xxhash64(x)))
    df = repeat_words(df) if repeats else df
    text, words = F.col("_lattica_t"), F.col("_lattica_w")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns({"_lattica_x": lines}).withColumns({
        named("n_words"): F.size(words).cast("long"),
        named("word_chars"): F.length(F.array_join(words, "")).cast("long"),
        named("n_symbols"): occurrences(text, SYMBOLS),
        named("n_dup_lines"): (F.size("_lattica_x") - F.size(F.array_distinct("_lattica_x"))).cast("long"),
    })
    if style:
        hashes = F.col("_lattica_h")
        df = df.withColumns({
            named("n_lines"): F.size("_lattica_x").cast("long"),
            named("n_upper"): occurrences(text, UPPER),
            named("n_stops"): occurrences(text, STOPS),
            named("n_bangs"): occurrences(text, "!"),
            named("n_bars"): occurrences(text, "[|]"),
            named("n_single"): F.size(F.filter(words, lambda x: F.length(x) == 1)).cast("long"),
            named("n_adjacent"): F.size(F.filter(hashes, lambda x, i: F.coalesce(F.get(hashes, i + 1) == x, F.lit(False)))).cast("long"),
            named("n_distinct"): F.size(F.array_distinct(hashes)).cast("long"),
        })
    return df.select(*docs.columns, *(c for c in counted_names() if c in df.columns))
