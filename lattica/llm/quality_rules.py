"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation learns how far to trust each.

Every rule votes good (1), bad (-1) or abstains (0) from a text's counts. The model has a share of good documents and, for
each rule and class, the probabilities of its three votes; it is fitted without labels over the votes of all documents,
from a weak belief that is the same for every rule. A rule whose bad votes fall on documents that others hold for good is
learned to be weak: alone it rejects nothing. A rule whose bad votes fall where the good votes of others are missing is
learned to be strong, and may outweigh them all.

Documents with the same votes are alike to the model, so it is fitted over the distinct vote patterns and their counts,
whatever the corpus' size. All of it is native: the fit is one expression over the array of patterns.

A document is kept if it passes the base rule and its posterior probability of being good is at least ``threshold``.

Defined results: a null or empty text has no words, fails the base rule and goes; repeated rows are judged each; an empty
table gives no rows; columns that clash with the added ones are replaced, all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable
from lattica.llm.features import COUNTS, count, named, settled, with_counts

ROUNDS = 40
#: What is believed of any rule beforehand: the shares of its votes (bad, none, good) on bad and on good documents. The
#: belief counts as much as this share of all documents; the classes are believed equally large at first.
BELIEF = ((0.3, 0.4, 0.3), (0.02, 0.38, 0.6))
BELIEF_WEIGHT = 1e-3
THRESHOLD = 0.5
MIN_WORDS = 10
#: Per cent of the words inside repeated windows.
MAX_REPEATED = 20
OUT = [*COUNTS, "base_failed", "p_good", "kept"]


def share(name: str, of: str = "n_words") -> Column:
    return count(name) / F.greatest(count(of), F.lit(1))


def vote(bad: Column, good: Column | None = None) -> Column:
    """Abstains for texts too short to tell, and if neither holds."""
    enough = count("n_words") >= MIN_WORDS
    votes = F.when(enough & bad, F.lit(-1))
    return (votes if good is None else votes.when(enough & good, F.lit(1))).otherwise(F.lit(0))


def standard_rules() -> dict[str, Column]:
    """Name -> vote. Limits are the usual ones of web-text filters.

    Rules that look for one fault abstain without it, since its absence says little. Rules that know how running text
    looks vote good, too. ``some_lines`` and ``line_length`` are weak on purpose: much good text breaks them.
    """
    length, per_line = share("word_chars"), share("n_words", "n_lines")
    return {
        "symbols": vote(share("n_symbols") > 0.1),
        "bars": vote(share("n_bars") > 0.1),
        "exclamations": vote(share("n_bangs") > 0.1),
        "capitals": vote(share("n_upper", "word_chars") > 0.25, share("n_upper", "word_chars").between(0.003, 0.08)),
        "stutter": vote(share("n_adjacent") > 0.1),
        "variety": vote(share("n_distinct") < 0.12, share("n_distinct") >= 0.4),
        "lines": vote(share("n_dup_lines", "n_lines") > 0.5),
        "some_lines": vote(share("n_dup_lines", "n_lines") > 0.1),
        "repeats": vote(share("n_repeat_words") > 0.2),
        "sentences": vote(share("n_stops") < 0.01, share("n_stops").between(0.02, 0.3)),
        "word_length": vote((length < 2.5) | (length > 12), length.between(3.5, 6.5)),
        "single_letters": vote(share("n_single") > 0.2),
        "line_length": vote((per_line < 8) | (per_line > 200), per_line.between(10, 150)),
    }


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Share of good documents, and the vote probabilities at 6 * rule + 3 * class + vote + 1; class 1 is good.

    ``patterns``: v (array of votes) and n.
    """
    k = n_rules
    belief = f"array({', '.join(f'{p}D' for shares in BELIEF for p in shares)})"
    odds = f"ln(st.pi / (1D - st.pi)) + aggregate(sequence(0, {k - 1}), 0D, (a, j) -> a + ln(st.t[6 * j + 4 + x.v[j]]) - ln(st.t[6 * j + 1 + x.v[j]]))"
    expect = f"transform(pats, x -> named_struct('v', x.v, 'n', x.n, 'p', 1D / (1D + exp(-({odds})))))"
    weighed = f"transform({expect}, x -> named_struct('v', x.v, 'good', x.n * x.p, 'bad', x.n * (1D - x.p)))"
    good = "aggregate(ps, 0D, (a, x) -> a + x.good)"
    cell = "aggregate(ps, 0D, (a, x) -> a + if(x.v[q div 6] = q % 3 - 1, if(q % 6 >= 3, x.good, x.bad), 0D))"
    shares = f"transform(sequence(0, {6 * k - 1}), q -> ({BELIEF_WEIGHT}D * n * {belief}[q % 6] + {cell}) / ({BELIEF_WEIGHT}D * n + if(q % 6 >= 3, g, n - g)))"
    # One element, so that what a lambda is given is worked out once.
    maximise = f"transform(array({good}), g -> named_struct('pi', (g + 1D) / (n + 2D), 't', {shares}))[0]"
    start = f"named_struct('pi', 0.5D, 't', transform(sequence(0, {6 * k - 1}), q -> {belief}[q % 6]))"
    whole = f"aggregate(sequence(1, {rounds}), {start}, (st, r) -> transform(array({weighed}), ps -> {maximise})[0])"
    row = (
        patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("pats"))
        .where(F.size("pats") > 0)
        .select("pats", F.expr("aggregate(pats, 0D, (a, x) -> a + x.n)").alias("n"))
        .select(F.expr(whole).alias("model"))
        .first()
    )
    return (row["model"]["pi"], list(row["model"]["t"])) if row else (0.5, [p for shares in BELIEF for p in shares] * k)


def log_ratio(votes: Column, model: tuple[float, list[float]], n_rules: int) -> Column:
    pi, t = model
    total = F.lit(math.log(pi / (1 - pi)))
    for j in range(n_rules):
        weights = [math.log(t[6 * j + 3 + v] / t[6 * j + v]) for v in range(3)]
        total = total + F.element_at(F.array(*map(F.lit, weights)), F.get(votes, F.lit(j)) + 2)
    return total


def apply_rules(docs: DataFrame, text_col: str = "text", rules: dict[str, Column] | None = None, threshold: float = THRESHOLD, rounds: int = ROUNDS, drop_text: bool = False) -> DataFrame:
    """``docs`` with the counts, base_failed, p_good and kept.

    The counts are written once to the shared folder, with the rows unless ``drop_text``: counting again for the second
    pass would take several times as long.
    """
    rules = rules or standard_rules()
    columns = [c for c in docs.columns if c not in OUT]
    counted = with_counts(docs, text_col).withColumn("_lattica_votes", settled(F.array(*rules.values())))
    counted = counted.select(*(c for c in columns if not (drop_text and c == text_col)), *(named(c) for c in COUNTS), "_lattica_votes")
    counted = durable(counted, "rule-counts")
    patterns = counted.groupBy(F.col("_lattica_votes").alias("v")).agg(F.count("*").alias("n"))
    model = fit(patterns, len(rules), rounds)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = counted.withColumnsRenamed({named(c): c for c in COUNTS}).withColumn("base_failed", failed)
    out = out.withColumn("p_good", 1 / (1 + F.exp(-log_ratio(F.col("_lattica_votes"), model, len(rules)))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop("_lattica_votes")
