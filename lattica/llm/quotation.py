"""Quotation linking: chats without quotes, in reply order. Native DataFrame operations only.

1. Leading ``>`` give each line its quote level. Runs of quoted lines of one level are passages.
2. Quoted lines are normalised (lower-cased, all but letters and digits dropped) and hashed (128 bits, so that no
   text is moved), and joined to the latest earlier message of the conversation that has the line as its own (level 0). The message that most characters of
   the outermost linked passages come from is the one replied to.
3. What is linked goes from the message's own text: the quoted lines that were found, in a message with such lines also
   the quoted lines without letters or digits, and the attribution line right before a line that goes. Quoted lines that
   nothing earlier holds stay as they are, marks included, since they may be code or arithmetic, or quote what is not here.
4. A message that replies to another than the one right before it opens a branch there. The reply path sorts a
   conversation depth first: a branch follows the messages that continue where it leaves, later branches first.

Looking up the latest earlier message is an as-of join. It runs in two levels, within blocks of ``BLOCK`` turns and over
one row for each block, so a conversation may hold any share of all rows. Only conversations with quotes take part.

Defined results: a null or empty text is an empty message; messages without a turn come first and are linked to nothing;
rows with the same conversation and turn are all kept and count as one message to link to; a null conversation is one of
its own; columns that clash with the added ones are replaced, all others stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import durable, is_empty

BLOCK = 256
#: One class of characters, since groups that repeat use a stack as deep as the line is long.
MARK = r"^[ \t>]*>[ \t]?"
#: How mail programs introduce a quote, in four languages.
ATTRIBUTION = r"^[ \t]*(On .+ wrote|Am .+ schrieb.*|Le .+ a écrit|El .+ escribió)[ \t]*:[ \t\r]*$"
#: Branches within branches are resolved by doubling; more rounds than a long has bits mean a fault.
MAX_ROUNDS = 63
ADDED = ["own_text", "max_level", "n_passages", "n_quoted_lines", "n_linked_lines", "parent_turn", "branch_depth", "reply_path"]


def digest(line: Column) -> Column:
    """Of a line's lower-cased letters and digits; empty without any. 128 bits stand for the line."""
    key = F.lower(F.regexp_replace(line, r"[^\p{L}\p{N}]+", ""))
    return F.when(key == "", F.lit(b"")).otherwise(F.unhex(F.md5(key)))


def lines_of(text: Column) -> Column:
    """(level, raw) of each line."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", ""))
    # Without any mark there is nothing to look for.
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.when(F.contains(x, F.lit(">")), level(x)).otherwise(0).alias("level"), x.alias("raw")))


def unmarked(x: Column) -> Column:
    return F.when(x["level"] > 0, F.regexp_replace(x["raw"], MARK, "")).otherwise(x["raw"])


def counted(messages: DataFrame, text_col: str) -> DataFrame:
    """``messages`` with the counts of quoted lines."""
    lines = F.when(F.contains(F.col(text_col), F.lit(">")), lines_of(F.col(text_col)))
    df = messages.drop(*ADDED).withColumn("_lattica_lines", lines)
    at = F.col("_lattica_lines")
    start = lambda x, i: (x["level"] > 0) & (F.coalesce(F.get(at, i - 1)["level"], F.lit(0)) != x["level"])
    counts = {
        "max_level": F.aggregate(at, F.lit(0), lambda a, x: F.greatest(a, x["level"])),
        "n_passages": F.size(F.filter(at, start)),
        "n_quoted_lines": F.size(F.filter(at, lambda x: x["level"] > 0)),
    }
    return df.withColumns({k: F.when(at.isNull(), 0).otherwise(c) for k, c in counts.items()}).drop("_lattica_lines")


def last_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` at a smaller ``order`` within ``keys``; rows are distinct in keys and order.

    Within a block of orders by a window; from earlier blocks by a window over one row for each block.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    within = rows.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    ends = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_end"))
    blocks = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(blocks)).drop("_end")
    return within.join(carried, [*keys, "_block"]).withColumn(name, F.coalesce("_near", "_far")).drop("_block", "_near", "_far")


def known_lines(lines: DataFrame) -> DataFrame:
    """(c, t, key, n, level, size, source): the quoted lines of each message, with the latest earlier message that has the line as its own."""
    usable = lines.where(F.length("key") > 0)
    quotes = usable.where("level > 0").groupBy("c", "t", "key").agg(F.min("level").alias("level"), F.count("*").alias("n"), F.first("size").alias("size"))
    wanted = quotes.select("c", "key").distinct()
    originals = usable.where("level = 0").select("c", "t", "key").distinct().join(wanted, ["c", "key"], "left_semi")
    places = originals.withColumn("src", F.col("t")).unionByName(quotes.select("c", "t", "key").withColumn("src", F.lit(None).cast("long")))
    places = places.groupBy("c", "t", "key").agg(F.max("src").alias("src"))
    known = last_before(places, ["c", "key"], "t", "src", "source").where(F.col("source").isNotNull()).select("c", "t", "key", "source")
    return quotes.join(known, ["c", "t", "key"]).select("c", "t", "key", "n", "level", "size", "source")


def replied_to(found: DataFrame) -> DataFrame:
    """(c, t, parent) for every message with linked lines."""
    outer = found.groupBy("c", "t").agg(F.min("level").alias("outer"))
    weights = found.join(outer, ["c", "t"]).where(F.col("level") == F.col("outer")).groupBy("c", "t", "source").agg(F.sum(F.col("n") * F.col("size")).alias("weight"))
    return weights.groupBy("c", "t").agg(F.max(F.struct("weight", "source")).getField("source").alias("parent"))


def gone_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(row, goes, n_linked) for the rows in which a quoted line is linked: whether each line goes, in order.

    ``lines``: row, c, t, i, level, key and introduces of all lines of quoting messages. No text is moved, and a message of
    any length stays linear.
    """
    met = lines.join(found.select("c", "t", "key", F.lit(True).alias("known")), ["c", "t", "key"], "left")
    goes = (F.col("level") > 0) & (F.col("known").isNotNull() | (F.length("key") == 0))
    rows = met.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("i", goes.alias("goes"), ((F.col("level") == 0) & F.col("introduces")).alias("introduces")))).alias("l"),
        F.count(F.when((F.col("level") > 0) & F.col("known"), 1)).alias("n_linked"),
    )
    next_goes = lambda i: F.coalesce(F.get(F.col("l"), i + 1)["goes"], F.lit(False))
    return rows.where("n_linked > 0").select("row", F.transform("l", lambda x, i: x["goes"] | (x["introduces"] & next_goes(i))).alias("goes"), "n_linked")


def without_quotes(text: Column, goes: Column) -> Column:
    kept = F.filter(F.zip_with(F.split(text, "\n"), goes, lambda x, g: F.struct(x.alias("line"), g.alias("goes"))), lambda x: ~x["goes"])
    joined = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return F.regexp_replace(F.btrim(joined, F.lit(" \t\n\x0b\f\r")), r"\n{3,}", "\n\n")


def padded(value: Column) -> Column:
    """Sorts as text like the number does, negative ones too."""
    return F.lpad((value.cast("decimal(20,0)") + F.lit(2).cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(20,0)")).cast("string"), 20, "0")


def branches(turns: DataFrame, links: DataFrame) -> DataFrame:
    """(c, start, prefix, depth): the turn that each branch opens at and the reply path of all its messages but their turn.

    ``turns``: all distinct (c, t) of the conversations with quotes.
    """
    before = last_before(turns.withColumn("own", F.col("t")), ["c"], "t", "own", "previous")
    opened = before.join(links.select("c", "t", "parent"), ["c", "t"]).where(F.col("parent") != F.col("previous")).select("c", F.col("t").alias("start"), "parent")
    opened = durable(opened, "branches")
    # The branch that the parent message belongs to is the last one opened up to it.
    events = opened.select("c", F.col("start").alias("t"), F.col("start").alias("opened")).unionByName(opened.select("c", (F.col("parent") + 1).alias("t"), F.lit(None).cast("long").alias("opened")))
    events = events.groupBy("c", "t").agg(F.max("opened").alias("opened"))
    up = last_before(events, ["c"], "t", "opened", "up").select("c", (F.col("t") - 1).alias("parent"), "up")
    step = F.concat(F.lit("/1"), padded(-F.col("parent")), padded(F.col("start")))
    out = durable(opened.join(up, ["c", "parent"], "left").select("c", "start", "up", step.alias("prefix"), F.lit(1).alias("depth")), "branch-paths")
    for _ in range(MAX_ROUNDS):
        if is_empty(out.where(F.col("up").isNotNull())):
            return out
        above = out.select("c", F.col("start").alias("up"), F.col("up").alias("next"), F.col("prefix").alias("first"), F.col("depth").alias("more"))
        joined = out.join(above, ["c", "up"], "left")
        out = durable(joined.select("c", "start", F.col("next").alias("up"), F.concat(F.coalesce("first", F.lit("")), "prefix").alias("prefix"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "branch-paths")
    raise RuntimeError("branches do not end")


def link_quotations(messages: DataFrame, conversation_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` with own_text, max_level, n_passages, n_quoted_lines, n_linked_lines, parent_turn, branch_depth and reply_path.

    ``in_reply_order`` gives the conversations.
    """
    place = {"_lattica_c": F.coalesce(F.concat(F.lit("="), F.col(conversation_col).cast("string")), F.lit("")), "_lattica_t": F.col(turn_col).cast("long")}
    df = counted(messages.withColumns(place), text_col)
    columns = [c for c in df.columns if not c.startswith("_lattica_")]
    added = [c for c in ADDED if c not in columns]
    own_path, whole = F.coalesce(padded(F.col("_lattica_t")), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    quotes = (F.col("n_quoted_lines") > 0) & F.col("_lattica_t").isNotNull()
    if is_empty(df.where(quotes)):
        out = df.withColumns({"own_text": whole, "n_linked_lines": F.lit(0).cast("long"), "parent_turn": F.lit(None).cast("long"), "branch_depth": F.lit(0), "reply_path": F.concat(F.lit("/0"), own_path)})
        return out.select(*columns, *added)
    df = durable(df.withColumn("_lattica_row", F.monotonically_increasing_id()), "messages")
    turned = df.where("_lattica_t IS NOT NULL").select(F.col("_lattica_c").alias("c"), F.col("_lattica_t").alias("t"), F.col("_lattica_row").alias("row"), F.col(text_col).alias("text"), "n_quoted_lines")
    quoting = durable(turned.where("n_quoted_lines > 0").select("c").distinct(), "quoting")
    # What is looked up: a short row for each line of the conversations with quotes.
    each = turned.select("c", "t", "row", (F.col("n_quoted_lines") > 0).alias("quotes"), F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("i", "x"))
    bare = unmarked(F.col("x"))
    each = each.select("c", "t", "row", "quotes", "i", "x.level", digest(bare).alias("key"), F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")).alias("size"), (F.col("quotes") & bare.rlike(ATTRIBUTION)).alias("introduces"))
    lines = durable(each.join(quoting, "c", "left_semi"), "lines")
    found = durable(known_lines(lines), "known-lines")
    links = durable(replied_to(found), "quote-links")
    rows = lines.where("i = 0").select("row", "c", "t")
    turns = durable(rows.select("c", "t").distinct(), "turns")
    opened = branches(turns, links)
    # Each message belongs to the last branch opened up to its turn.
    marks = turns.withColumn("u", F.col("t") + 1).select("c", F.col("u").alias("t"), F.lit(None).cast("long").alias("opened")).unionByName(opened.select("c", F.col("start").alias("t"), F.col("start").alias("opened")))
    marks = marks.groupBy("c", "t").agg(F.max("opened").alias("opened"))
    held = last_before(marks, ["c"], "t", "opened", "start").select("c", (F.col("t") - 1).alias("t"), "start")
    places = held.join(opened.select("c", "start", "prefix", "depth"), ["c", "start"]).select("c", "t", "prefix", "depth")
    known = links.join(places, ["c", "t"], "full_outer")
    gone = gone_lines(lines.where("quotes"), found)
    # One row for each message that is not as it was, so that texts meet them once.
    changed = rows.join(known, ["c", "t"]).join(gone, "row", "left").select(F.col("row").alias("_lattica_row"), F.struct("parent", "prefix", "depth", "goes", "n_linked").alias("_lattica_of"))
    of = lambda name: F.col(f"_lattica_of.{name}")
    out = df.join(changed, "_lattica_row", "left").withColumns({
        "own_text": F.when(of("goes").isNotNull(), without_quotes(whole, of("goes"))).otherwise(whole),
        "n_linked_lines": F.coalesce(of("n_linked"), F.lit(0)).cast("long"),
        "parent_turn": of("parent"),
        "branch_depth": F.coalesce(of("depth"), F.lit(0)),
        "reply_path": F.concat(F.coalesce(of("prefix"), F.lit("")), F.lit("/0"), own_path),
    })
    return out.select(*columns, *added)


def in_reply_order(linked: DataFrame, conversation_col: str = "conv_id") -> DataFrame:
    """The messages of ``link_quotations`` by conversation and, within one, in reply order.

    A sort over all rows, so a conversation may go over many partitions; those with equal paths are in no order.
    """
    return linked.orderBy(conversation_col, "reply_path")
