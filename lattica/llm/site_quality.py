"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on a text's form gives each document's own evidence. Its expected counts of good documents are
summed by path within host and by host, and shrunk: a host towards the corpus, a path towards its host, each with a
strength estimated from how far the sites' shares really differ (method of moments), so that sparse sites stay near their
parent and large ones speak for themselves. The site's posterior then replaces the corpus-wide prior of the document's
own probability; a document never counts as evidence for itself.

All sums are grouped aggregations with partial sums before the shuffle, so one host may hold any share of the rows; the
join back leaves the rows of large sites, texts and all, where they are and shuffles only those of small ones.

The logistic model is fitted on at most ``max_labels`` labelled documents, taken by a hash of the id, one for each id and
label; everything else covers all rows.

Defined results: a null text counts as empty; a null host or path is a site of its own; a null label is no label; repeated
rows are scored each; without labels of both classes all documents score 0.5 and are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable
from lattica.llm.features import count, settled, with_counts
from lattica.llm.spread import spread_join

MAX_LABELS = 20_000
THRESHOLD = 0.5
#: Of newton steps, and of the squared weights.
STEPS, RIDGE = 25, 1.0
#: Limits of a shrinkage strength, in documents.
STRENGTHS = (2.0, 1e6)
#: A document's own log odds are held within these, so that no text overrules its site for certain.
MAX_ODDS = 12.0
OUT = ["host", "path", "p_document", "p_host", "p_path", "p_quality", "kept"]


def form() -> dict[str, Column]:
    """What the model sees of a text."""
    words, chars = F.greatest(count("n_words"), F.lit(1)), F.greatest(count("word_chars"), F.lit(1))
    of_words = lambda c: count(c) / words
    made = {
        "length": F.log1p(count("n_words")),
        "word_length": F.least(of_words("word_chars"), F.lit(30.0)),
        "symbols": F.least(of_words("n_symbols"), F.lit(2.0)),
        "has_bars": F.least(of_words("n_bars"), F.lit(1.0)),
        "bangs": F.least(of_words("n_bangs"), F.lit(2.0)),
        "stops": F.least(of_words("n_stops"), F.lit(2.0)),
        "capitals": count("n_upper") / chars,
        "single": of_words("n_single"),
        "adjacent": of_words("n_adjacent"),
        "distinct": of_words("n_distinct"),
        "dup_lines": count("n_dup_lines") / F.greatest(count("n_lines"), F.lit(1)),
    }
    steep = {f"{k}_root": F.sqrt(made[k]) for k in ("symbols", "has_bars", "bangs", "adjacent")}
    return made | steep


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept by damped Newton steps on standardised columns, given back for the raw ones."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[0] = 1e-3
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    weights = w[1:] / scale
    return weights, float(w[0] - weights @ mean)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labels: int) -> tuple[list[float], float] | None:
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().distinct()
    labels = labels.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labels)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(labels), "_id")  # at most max_labels rows of two numbers
    # Of the rows that share an id one is taken, so that no more rows come than labels.
    joined = joined.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), "_text")).getField("_text").alias("_text"))
    rows = with_counts(joined, "_text", repeats=False).select("_y", *(c.alias(k) for k, c in form().items())).collect()
    if len({r["_y"] for r in rows}) < 2:
        return None
    data = np.array([list(r) for r in rows], float)
    data = data[np.lexsort(data.T)]  # the same sums in whatever order rows come
    weights, intercept = fit_logistic(data[:, 1:], (data[:, 0] > 0.5).astype(float))
    return weights.tolist(), intercept


def scored(docs: DataFrame, text_col: str, host: Column, path: Column, model: tuple[list[float], float] | None) -> DataFrame:
    """``docs`` with host, path and p_document."""
    df = docs.withColumns({"_lattica_host": host, "_lattica_path": path})
    kept = [c for c in docs.columns if c not in OUT]
    if model is None:
        odds = F.lit(0.0)
    else:
        df = with_counts(df, text_col, repeats=False)
        odds = F.lit(model[1])
        for w, c in zip(model[0], form().values(), strict=True):
            odds = odds + F.lit(w) * c
        odds = F.greatest(F.least(odds, F.lit(MAX_ODDS)), F.lit(-MAX_ODDS))
    df = df.withColumn("_lattica_p", settled(1 / (1 + F.exp(-odds))))
    return df.select(*kept, F.col("_lattica_host").alias("host"), F.col("_lattica_path").alias("path"), F.col("_lattica_p").alias("p_document"))


def strength(share: float, rows: DataFrame, parent: Column) -> float:
    """Pseudo-documents of a parent, from its children's ``n`` and ``s``, by the method of moments."""
    n, rate = F.col("n"), F.col("s") / F.col("n")
    m = rows.where(n > 1).agg(
        F.sum(n * (rate - parent) ** 2).alias("between"), F.sum(parent * (1 - parent)).alias("noise"), F.sum(n).alias("n"), F.count("*").alias("sites"), F.sum(n * parent * (1 - parent)).alias("spread")
    ).first()
    if not m["sites"] or m["sites"] < 2 or not m["n"] or not m["spread"]:
        return STRENGTHS[1]
    excess = (m["between"] - m["noise"]) / m["n"]
    spread = m["spread"] / m["n"]
    return min(max(spread / excess - 1, STRENGTHS[0]), STRENGTHS[1]) if excess > 0 else STRENGTHS[1]


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS, threshold: float = THRESHOLD, drop_text: bool = False) -> DataFrame:
    """``docs`` with host, path, p_document, p_host, p_path, p_quality and kept; columns of these names are replaced.

    The documents' own scores are written once to the shared folder, with the rows unless ``drop_text``.
    """
    own = scored(docs, text_col, host, path, train(docs, labels, id_col, text_col, label_col, max_labels))
    own = durable(own.drop(text_col) if drop_text else own, "document-scores")
    columns = own.columns
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731 # a null is a site, too
    own = own.withColumns({"_lattica_h": key("host"), "_lattica_p": key("path")})
    own = own.withColumn("_lattica_key", F.concat(F.length("_lattica_h").cast("string"), F.lit(":"), "_lattica_h", "_lattica_p"))
    paths = durable(own.groupBy("_lattica_key", "_lattica_h").agg(F.count("*").alias("n"), F.sum("p_document").alias("s")), "paths")
    hosts = durable(paths.groupBy("_lattica_h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    k_host = strength(mean, hosts, F.lit(mean))
    posterior = (F.lit(k_host * mean) + F.col("s")) / (F.lit(k_host) + F.col("n"))
    of_host = hosts.select("_lattica_h", F.struct(F.col("n").alias("n_host"), F.col("s").alias("s_host")).alias("_lattica_of"), posterior.alias("parent"))
    sites = paths.join(of_host, "_lattica_h")
    k_path = strength(mean, sites, F.col("parent"))
    site = F.struct(F.col("_lattica_of.n_host"), F.col("_lattica_of.s_host"), F.col("n").alias("n_path"), F.col("s").alias("s_path"))
    sites = durable(sites.select("_lattica_key", site.alias("_lattica_site")), "sites")
    of = lambda name: F.col(f"_lattica_site.{name}")
    p = F.col("p_document")
    out = spread_join(own, sites, "_lattica_key", "left").withColumn("p_host", (F.lit(k_host * mean) + of("s_host") - p) / (F.lit(k_host - 1) + of("n_host")))
    out = out.withColumn("p_path", (F.lit(k_path) * F.col("p_host") + of("s_path") - p) / (F.lit(k_path - 1) + of("n_path")))
    held = F.greatest(F.least(F.col("p_path"), F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = F.log(p / (1 - p)) + F.log(held / (1 - held)) - F.lit(math.log(mean / (1 - mean)))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", F.col("p_quality") >= threshold).select(*columns, "p_host", "p_path", "p_quality", "kept")
