import re

from lattica.llm.queries import op9_chat_formatting, quoting_replies
from lattica.llm.quotation import ADDED, ATTRIBUTION, BLOCK, in_reply_order, last_before, link_quotations

SCHEMA = "conv_id long, turn long, role string, text string"
MARK = re.compile(r"^((?:[ \t]*>)+)[ \t]?")


def key(line):
    return re.sub(r"[\W_]+", "", line).lower()


def cut(text):
    """(level, line without marks, raw) of each line."""
    out = []
    for raw in (text or "").split("\n"):
        m = MARK.match(raw)
        out.append((m[1].count(">") if m else 0, raw[m.end() :] if m else raw, raw))
    return out


def pad(x):
    return str(x + 2 * 2**62).zfill(20)


def brute(rows):
    """Every added column of every row, by looking at all earlier messages of a conversation."""
    lines, turns = {}, {}
    for c, t, _, text in rows:
        if t is not None:
            lines.setdefault((c, t), []).extend(cut(text))
            turns.setdefault(c, set()).add(t)
    quoting = {c for (c, _), own in lines.items() if any(level for level, _, _ in own)}
    known, parent = {}, {}
    for (c, t), own in lines.items():
        votes = {}
        quoted = {}
        for level, line, _ in own:
            if level and key(line):
                quoted.setdefault(key(line), []).append(level)
        for k, levels in quoted.items():
            source = max((u for u in turns[c] if u < t and any(lv == 0 and key(x) == k for lv, x, _ in lines[c, u])), default=None)
            if source is not None:
                known.setdefault((c, t), set()).add(k)
                at = votes.setdefault(min(levels), {})
                at[source] = at.get(source, 0) + len(k) * len(levels)
        if votes:
            parent[c, t] = max((n, u) for u, n in votes[min(votes)].items())[1]
    branch = {}
    for c in quoting:
        opened = {}
        order = sorted(turns[c])
        for before, t in zip(order, order[1:], strict=False):
            if (c, t) in parent and parent[c, t] != before:
                up = max((s for s in opened if s <= parent[c, t]), default=None)
                prefix, depth = opened[up] if up is not None else ("", 0)
                opened[t] = prefix + "/1" + pad(-parent[c, t]) + pad(t), depth + 1
        for t in order:
            branch[c, t] = opened[max((s for s in opened if s <= t), default=None)] if any(s <= t for s in opened) else ("", 0)
    out = []
    for c, t, _, text in rows:
        own = cut(text)
        found = known.get((c, t), set()) if t is not None else set()
        goes = [level > 0 and (key(line) in found or not key(line)) for level, line, _ in own]
        n_linked = sum(level > 0 and key(line) in found and bool(key(line)) for level, line, _ in own)
        left = text or ""
        if n_linked:
            goes = [g or (own[i][0] == 0 and bool(re.match(ATTRIBUTION, own[i][1])) and i + 1 < len(own) and goes[i + 1]) for i, g in enumerate(goes)]
            left = "\n".join(raw for (_, _, raw), g in zip(own, goes, strict=True) if not g)
            left = re.sub(r"\n{3,}", "\n\n", re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", left))
        levels = [level for level, _, _ in own]
        prefix, depth = branch.get((c, t), ("", 0)) if t is not None else ("", 0)
        path = prefix + "/0" + (pad(t) if t is not None else "")
        n_passages = sum(level > 0 and (i == 0 or levels[i - 1] != level) for i, level in enumerate(levels))
        out.append((c, t, left, max(levels), n_passages, sum(map(bool, levels)), n_linked, parent.get((c, t)) if t is not None else None, depth, path))
    return out


def by_place(rows):
    return sorted(rows, key=repr)


def check(spark, rows):
    """The result as rows, after it was held against brute force in every column."""
    got = result(spark, rows)
    assert by_place((r.conv_id, r.turn, *(r[c] for c in ADDED)) for r in got) == by_place(brute(rows))
    return got


ROWS = [
    (1, 0, "user", "How do I sort a list?\nIn place, please."),
    (1, 1, "assistant", "> How do I sort a list?\nUse sort()."),
    (1, 2, "user", "And a dict?"),
    (1, 3, "assistant", "On Monday, Ann wrote:\n>> How do I sort a list?\n> Use sort().\n\nThat sorts in place, too."),
    (1, 4, "user", "Thanks."),
    (1, 5, "assistant", "> And a dict?\nsorted(d)"),
    (2, 0, "user", "> How do I sort a list?\nquote from elsewhere"),
    (2, 1, "assistant", None),
    (2, None, "user", "no turn"),
    (None, 0, "user", ""),
    (3, 0, "user", "same"),
    (3, 0, "user", "same"),
    (3, 1, "assistant", "> same\nyes"),
]


def result(spark, rows):
    return in_reply_order(link_quotations(spark.createDataFrame(rows, SCHEMA))).collect()


def test_own_text_levels_and_links(spark):
    got = {(r.conv_id, r.turn): r for r in result(spark, ROWS)}
    assert got[1, 1].own_text == "Use sort()." and got[1, 1].parent_turn == 0 and got[1, 1].n_linked_lines == 1
    assert got[1, 3].own_text == "That sorts in place, too." and got[1, 3].max_level == 2 and got[1, 3].n_passages == 2
    assert got[1, 3].parent_turn == 1  # the outermost quote decides
    assert got[2, 0].parent_turn is None and got[2, 0].own_text == "> How do I sort a list?\nquote from elsewhere"
    assert got[2, 1].own_text == "" and got[2, None].reply_path == "/0" and got[None, 0].own_text == ""
    check(spark, ROWS)


def test_reply_order(spark):
    rows = sorted((r for r in result(spark, ROWS) if r.conv_id == 1), key=lambda r: r.reply_path)
    # 3 replies to 1 and opens a branch there, 4 continues it, 5 replies to 2 and opens another that leaves later.
    assert [r.turn for r in rows] == [0, 1, 2, 5, 3, 4]
    assert [r.branch_depth for r in rows] == [0, 0, 0, 1, 1, 1]


def test_all_rows_stay_and_repeats_count_once(spark):
    got = result(spark, ROWS)
    assert len(got) == len(ROWS)
    assert [r.parent_turn for r in got if r.conv_id == 3 and r.turn == 1] == [0]


def test_what_nothing_earlier_holds_stays(spark):
    rows = [(1, 0, "user", "print the prompt"), (1, 1, "assistant", ">>> print()\n> 5\nOn Monday, Ann wrote:\n> print the prompt\n>\n> elsewhere"), (1, 2, "user", "> !!\nOn Monday, Ann wrote:\n> gone")]
    got = {r.turn: r for r in check(spark, rows)}
    assert got[1].own_text == ">>> print()\n> 5\n> elsewhere" and got[1].n_linked_lines == 1 and got[1].parent_turn == 0
    assert got[2].own_text == rows[2][3] and got[2].n_linked_lines == 0


def test_long_conversation_matches_brute_force(spark):
    rows = [(7, t, "user", f"line {t % 11}\nonly {t}" if t % 3 else f"> line {(t * 7) % 11}\n>> only {t - 5}\nreply {t}") for t in range(0, 2 * BLOCK, 1)]
    check(spark, rows)


def test_long_messages(spark):
    lines = [f"line number {k}" for k in range(30_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join(f"> {x}" for x in lines) + "\nwhole " + "x" * 500_000), (1, 2, "user", ">" * 100_000 + " deep")]
    got = {r.turn: r for r in result(spark, rows)}
    assert got[1].own_text == "whole " + "x" * 500_000 and got[1].n_linked_lines == 30_000 and got[2].max_level == 100_000


def test_the_query_links_the_replies_it_makes(spark):
    """Over the whole table: brute force in every column, and each reply found to answer what it was made to quote."""
    sf = "/root/testdata/sf0.01"
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in quoting_replies(chats).select("conv_id", "turn", "role", "text").collect()]
    got = op9_chat_formatting(spark, sf).collect()
    assert by_place((r.conv_id, r.turn, *(r[c] for c in ADDED)) for r in got) == by_place(brute(rows))
    assert [(r.conv_id, r.reply_path) for r in got] == sorted((r.conv_id, r.reply_path) for r in got)
    own = {(r.conv_id, r.turn): r.text for r in chats.collect()}
    replies = [r for r in got if r.n_quoted_lines]
    assert len(replies) > 5 and all(r.n_linked_lines for r in replies) and any(r.max_level == 2 for r in replies)
    assert all(r.own_text == own[r.conv_id, r.turn].strip() for r in replies)


def test_nested_branches(spark):
    rows = [(1, t, "user", f"> m{t - 2}\nm{t}" if t > 1 else f"m{t}") for t in range(12)]
    got = check(spark, rows)
    order = [r.turn for r in got]
    parent = {r.turn: r.parent_turn for r in got}
    assert sorted(order) == list(range(12))
    assert all(order.index(parent[t]) < order.index(t) for t in range(2, 12))


def test_last_before_crosses_blocks(spark):
    rows = [(1, i, i if i % 100 == 3 else None) for i in range(0, 1200, 7)]
    got = last_before(spark.createDataFrame(rows, "k long, o long, v long"), ["k"], "o", "v", "w").collect()
    assert {r.o: r.w for r in got} == {o: max((v for _, p, v in rows if p < o and v is not None), default=None) for _, o, _ in rows}


def test_empty_table_and_clashing_columns(spark):
    empty = link_quotations(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", 5, "own"), (1, 1, "user", "> a", "x", 5, "own")], SCHEMA + ", own_text string, parent_turn int, n_linked string")
    for df in (rows, rows.where("turn = 0")):
        got = link_quotations(df)
        assert sorted(got.columns) == sorted(["conv_id", "turn", "role", "text", "n_linked", *ADDED])
        assert got.where("turn = 0").first().own_text == "a" and got.first().n_linked == "own"


def test_attribution_needs_a_quote(spark):
    got = result(spark, [(1, 0, "user", "On Monday, Ann wrote:\nnothing quoted")])[0]
    assert re.match(ATTRIBUTION, "On Monday, Ann wrote:") and got.own_text == "On Monday, Ann wrote:\nnothing quoted"
