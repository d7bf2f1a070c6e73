"""Operator 10, quality rules: weak supervision instead of all-must-pass filters.  DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the vote patterns of the whole corpus
(at most 3**rules, whatever the corpus) estimates how often each rule says good, or bad, of good and of bad documents; the posterior
probability of being good decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: windows are sorted by hash with their places, equal neighbours
    marked, and the union of their places measured."""

    def count(windows: Column) -> Column:
        def marked(k):
            x = F.get(windows, k)["h"]
            same = lambda other: F.coalesce(F.get(windows, other)["h"] == x, F.lit(False))
            return same(k - 1) | same(k + 1)

        at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(windows) - 1), marked), lambda k: F.get(windows, k)["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    def windows_of(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def some(hashes: Column) -> Column:
        paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(paired, count))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows_of(words), some))


def features_column(text: Column) -> Column:
    """The counts that rules use, as a struct.  Null text counts as empty."""

    def measure(w: Column, t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            lines,
            lambda ln: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
                F.size(ln).cast("long").alias("n_lines"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
                F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
                F.size(F.filter(w, lambda x: x.rlike(r"^[#*$%&|<>]|[#*$%&|<>]$"))).cast("long").alias("n_marked_words"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda w: measure(w, t)))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def votes(f: Column) -> Column:
    """The rules, in fixed order.  Each has a band in which it abstains.

    Two rules look at a document's own length: over 100,000 words the first abstains, and from 2000 words on the last finds no fault with few distinct
    words, whose share falls in any long text.  Neither depends on the size of the table.
    """
    n = F.greatest(f["n_words"], F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    length, symbols = f["word_chars"] / n, f["n_symbols"] / n
    dups, repeats = f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)), f["n_repeat_words"] / n
    return F.array(
        rule((n >= 60) & (n <= 100_000), n < 50),
        rule((length >= 3) & (length <= 10), (length < 2) | (length > 15)),
        rule(symbols <= 0.05, symbols > 0.2),
        rule(dups <= 0.1, (dups > 0.3) & (f["n_dup_lines"] >= 3)),  # one repeat among three lines is chance
        rule(repeats <= 0.2, repeats > 0.4),
        rule(f["n_alpha_words"] / n >= 0.8, f["n_alpha_words"] / n < 0.6),
        rule(f["n_marked_words"] / n <= 0.05, f["n_marked_words"] / n > 0.2),
        rule(f["n_distinct_words"] >= 0.25 * n, (f["n_distinct_words"] < 0.1 * n) & (n < 2000)),
    )


RULES = 8


#: P(vote -1, 0, 1 | good) and P(... | bad) to begin with: a rule seldom finds fault with good documents, and with a third of the bad ones.
START = ((0.02, 0.08, 0.9), (0.35, 0.1, 0.55))


def fit_rules(patterns: DataFrame, rounds: int = 25, tolerance: float = 1e-4) -> dict:
    """Expectation-maximisation over (votes array, n long).  Returns prior and, by rule and class, P(vote | class), smoothed.

    Only the expected counts of each rule and vote, three rows a rule, reach the driver.  An empty table gives the start.
    """
    model: dict = {"prior": 0.7, "p": [[list(c) for c in START] for _ in range(RULES)]}
    for _ in range(rounds):
        each = patterns.select("n", posterior(F.col("votes"), model).alias("g"), F.posexplode("votes").alias("j", "v"))
        rows = each.groupBy("j", "v").agg(F.sum(F.col("n") * F.col("g")).alias("g"), F.sum("n").alias("n")).collect()
        if not rows:
            break
        n = {(r["j"], r["v"]): (r["g"], r["n"] - r["g"]) for r in rows}
        good, bad = (math.fsum(n.get((0, v), (0.0, 0.0))[c] for v in (-1, 0, 1)) for c in (0, 1))
        prior = min(0.95, max(0.05, (good + 1) / (good + bad + 2)))
        # a share of the start's counts keeps the classes from swapping names where one class is rare
        weight = 0.01 * (good + bad) + 1
        p = [[[(n.get((j, v), (0.0, 0.0))[c] + weight * START[c][v + 1]) / ((good, bad)[c] + weight) for v in (-1, 0, 1)] for c in (0, 1)] for j in range(RULES)]
        moved = max(abs(x - y) for new, old in zip(p, model["p"], strict=True) for s, t in zip(new, old, strict=True) for x, y in zip(s, t, strict=True))
        model = {"prior": prior, "p": p}
        if moved < tolerance:
            break
    return model


def posterior(v: Column, model: dict) -> Column:
    """P(good | votes): rules are independent given the class.  The odds are one constant array, so every round runs the same code."""
    odds = F.array(*(F.lit(math.log(g / b)) for good, bad in model["p"] for g, b in zip(good, bad, strict=True)))
    score = F.aggregate(F.transform(v, lambda x, j: F.get(odds, 3 * j + x + 1)), F.lit(math.log(model["prior"] / (1 - model["prior"]))), lambda acc, x: acc + x)
    return 1 / (1 + F.exp(-score))


def judge_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``df``: its id, the counts, votes, ``p_good`` (double), ``base_failed`` and ``kept``.

    Documents under 50 words, or with over half of their words in repeated 3-word windows, fail outright; the others stay if the posterior
    reaches the threshold.  Null text is empty text and fails; repeated rows are judged alike; other columns are not read, whatever their names; an empty
    table gives an empty result.  The counts are written once; texts are neither shuffled nor read twice.
    """
    f = F.col("f")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), features_column(F.col(f"`{text_col}`")).alias("f"))
    table = materialise(rows.select("id", "f.*", votes(f).alias("votes"), base_failed(f).alias("base_failed")), "quality")
    model = fitted(table)
    return table.withColumn("p_good", posterior(F.col("votes"), model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def fitted(table: DataFrame) -> dict:
    """The model of a written table's votes."""
    patterns = materialise(table.groupBy("votes").agg(F.count("*").alias("n")), "votes")
    model = fit_rules(patterns)
    discard(patterns)
    return model


def keep_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that :func:`judge_quality` keeps, all columns as they are.

    Rows are written once beside their votes, so that texts are counted once, ids may be null or repeated, and nothing is joined.  Columns of any name stay
    apart from those that the rules make; null text fails; an empty table gives an empty result.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    verdict = let(features_column(F.col(f"`{text_col}`")), lambda f: F.struct(votes(f).alias("votes"), base_failed(f).alias("base_failed")))
    table = materialise(df.select(row, verdict.alias("v")).select("row", "v.*"), "judged")
    return table.where(~F.col("base_failed") & (posterior(F.col("votes"), fitted(table)) >= threshold)).select("row.*")
