"""URL filters: host-suffix and path-prefix expressions, joined to the rules by a short hash prefix.

A URL is expanded into every suffix of its host (whole labels, no more than the rules' hosts have) combined with every
prefix of its path whose length some rule's path has. Each expression is hashed; urls and rules meet in an equi-join on the first ``PREFIX_HEX`` digits,
then the full digest is confirmed and the longest rule wins. Only the page's row number and the expression take part, and
the reduction to one row per page starts before the shuffle.

Expressions such as a top-level domain are as common as a third of all rows, so the shuffled form of the join salts
the urls' side and repeats the rules, which are few. The rules are broadcast only if they are at most
``MAX_BROADCAST_RULES``.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; repeated pages are judged
row by row; rules that are null in any part are ignored; of equally long rules the one with the longer host wins, then
``block``, then the smaller text. Without a rule the verdict is ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_HEX = 8
MAX_BROADCAST_RULES = 10_000
SALTS = 32
RULES = T.StructType([T.StructField(n, T.StringType()) for n in ("rule_host", "rule_path", "verdict")])

#: The rules of the registered query.
STANDARD = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def prepared(rules: DataFrame) -> DataFrame:
    """Digest, its prefix and the rank of each distinct rule."""
    rules = rules.select(F.translate("rule_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), "rule_path", "verdict").dropna().distinct()
    text = F.concat("rule_host", "rule_path")
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    return rules.select(
        F.substring(digest, 1, PREFIX_HEX).alias("rule_prefix"),
        digest.alias("rule_digest"),
        F.struct(
            F.length(text).alias("length"),
            F.length("rule_host").alias("host_length"),
            (F.col("verdict") == "block").cast("int").alias("blocks"),
            text.alias("rule"),
            F.col("verdict").alias("rule_verdict"),
        ).alias("found"),
        F.length("rule_path").alias("path_length"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
    )


def expressions(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """The (host suffix, path prefix) texts of a URL that a rule may have, as an array; no rule's host has more labels."""
    labels = F.split(host, r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - most_labels + 1, F.lit(1)), F.lit(most_labels))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\n", s, p)))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict; columns of those names are replaced."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rules = prepared(rules)
    size = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path_length")).alias("lengths"), F.max("labels").alias("labels")).first()
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_page") if kept else F.lit(None).alias("_page"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    if not size["n"]:
        found = rows.withColumn("found", F.lit(None).cast(rules.schema["found"].dataType))
    else:
        # Without a scheme there is nothing to fit: such rows carry one expression that no rule has.
        listed = F.when(F.col("host") == "", F.array(F.lit("\n"))).otherwise(expressions(F.col("host"), F.col("path"), size["lengths"], size["labels"]))
        listed = F.when(F.size(listed) == 0, F.array(F.lit("\n"))).otherwise(listed)
        expanded = rows.select("*", F.explode(listed).alias("expression")).withColumn("digest", F.sha2("expression", 256)).drop("expression")
        meets = (F.substring("digest", 1, PREFIX_HEX) == F.col("rule_prefix")) & (F.col("digest") == F.col("rule_digest"))
        if size["n"] <= max_broadcast_rules:
            joined = expanded.join(F.broadcast(rules), meets, "left")
        else:
            expanded = expanded.withColumn("salt", F.pmod("_row", F.lit(SALTS)))
            spread = rules.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("rule_salt"))
            joined = expanded.join(spread, meets & (F.col("salt") == F.col("rule_salt")), "left")
        found = joined.groupBy("_row").agg(F.max("found").alias("found"), F.first("_page").alias("_page"), F.first("host").alias("host"), F.first("path").alias("path"))
    return found.select(
        *(F.col("_page").getField(c).alias(c) for c in kept),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.rule_verdict", F.lit(default)).alias("verdict"),
    )
