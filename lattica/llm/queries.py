"""The registered queries of this subpackage, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import oracles
from lattica.llm.common import durable, shared_folder, table
from lattica.llm.decontamination import decontaminate
from lattica.llm.html_text import extract_text
from lattica.llm.jaccard_join import near_duplicates
from lattica.llm.packing import pack
from lattica.llm.quality_rules import apply_rules
from lattica.llm.quotation import in_reply_order, link_quotations
from lattica.llm.site_quality import classify
from lattica.llm.token_counts import token_counts
from lattica.llm.url_rules import STANDARD, judge_urls, rule_table
from lattica.llm.warc import audit, read_warc, record, write_warc


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, its path there the section of its language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), drop_text=True)
    return out.select("doc_id", "host", "path", "p_document", "p_host", "p_path", "p_quality", "kept")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, STANDARD)).select("page_id", "host", "path", "rule", "verdict")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, language and text as one document; its sections are the two fields and the lines of the text."""
    fields = ["source", "lang", "text"]
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", *fields), fields, drop_fields=True)
    return out.select("doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "section_starts")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as two WARC replicas; in the second, one in 256 records, by the digest of its id, has a changed byte.

    The audit has to find these records, and no others. Every record is returned with the digest of its bytes in the
    first replica.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    own = record(F.col("page_id"), F.col("url"), F.col("html"))
    chosen = F.sha2(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 256).startswith("00")
    # The last byte of the header's type, so that lengths stay as they are.
    damaged = F.when(chosen, F.replace(own, F.lit("Content-Type: text/html"), F.lit("Content-Type: text/htmm"))).otherwise(own)
    base = f"{shared_folder(spark).rstrip('/')}/lattica-warc-{uuid.uuid4().hex}"
    replicas = []
    for name, column in (("ours", own), ("theirs", damaged)):
        write_warc(pages.select(column.alias("record")), "record", f"{base}/{name}")
        replicas.append(durable(read_warc(spark, f"{base}/{name}"), f"leaves-{name}"))
    found = audit(*replicas)
    page = F.expr("try_cast(replace(record_id, 'urn:record:', '') AS bigint)")
    out = replicas[0].join(found, ["file", "seq"], "left")
    return out.select(page.alias("page_id"), "length", F.col("digest").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), drop_text=True)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def quoting_replies(chats: DataFrame) -> DataFrame:
    """``chats`` in which about one message of eight, by the digest of its place, quotes one or two earlier ones.

    The digest's first digit says whether, the second how far back, the third whether the message before the quoted one
    is quoted within the quote. Where that earlier turn does not exist nothing is quoted.
    """
    digest = F.sha2(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
    digit = lambda i: F.conv(F.substring(digest, i, 1), 16, 10).cast("int")
    quotes = F.coalesce((digit(1) < 2) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.lit(False))
    replies = chats.where(quotes).withColumn("outer_turn", F.col("turn") - 1 - digit(2) % 4).withColumn("inner_turn", F.when(digit(3) % 2 == 0, F.col("outer_turn") - 1))
    # Only what is quoted is looked up, so most texts move once.
    wanted = replies.select("conv_id", F.explode(F.array("outer_turn", "inner_turn")).alias("turn")).dropna().distinct()
    earlier = chats.join(wanted, ["conv_id", "turn"], "left_semi").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    said = lambda name: earlier.select("conv_id", F.col("turn").alias(f"{name}_turn"), F.col("said").alias(name))
    df = replies.join(said("outer"), ["conv_id", "outer_turn"], "left").join(said("inner"), ["conv_id", "inner_turn"], "left")
    marked = lambda text, mark: F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(mark), x)), "\n")
    nested = F.when(F.col("inner").isNotNull(), F.concat(marked(F.col("inner"), ">> "), F.lit("\n"))).otherwise("")
    quote = F.concat(F.lit("On Monday, somebody wrote:\n"), nested, marked(F.col("outer"), "> "), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    df = df.withColumn("text", F.when(F.col("outer").isNotNull(), quote).otherwise(F.col("text"))).select(*chats.columns)
    return df.union(chats.where(~quotes))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with quotes of earlier messages put into some replies, without the quotes and in reply order."""
    out = in_reply_order(link_quotations(quoting_replies(table(spark, sf_dir, "conversations"))))
    return out.select("conv_id", "turn", "role", "own_text", "max_level", "n_passages", "n_quoted_lines", "n_linked_lines", "parent_turn", "branch_depth", "reply_path")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_html_extraction": op2_html_extraction,
        "op3_url_filters": op3_url_filters,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_token_counts": op6_token_counts,
        "op7_warc_fixity": op7_warc_fixity,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
