"""Operator 4, URL filter: rules first, then a character language-model ratio.  DataFrame functions only.

URLs that a rule decides are the accepted and the rejected ones.  For each class a variable-order Markov model over characters is
counted from four fifths of them; its probabilities are interpolated from the longest context down (Witten-Bell).  A URL's score is the difference
of its log-likelihoods, divided by its length; the threshold is calibrated on the other fifth.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, materialise

#: Characters of context, the inverse share of labelled URLs held out, micro-nats a nat, and micro-nats a calibration bin.
ORDER, FOLDS, MICRO, BIN = 4, 5, 1_000_000, 10_000
BOS, EOS = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fold_of(url: Column) -> Column:
    """A number below FOLDS, the same for equal URLs; fold 0 is held out."""
    return F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % FOLDS


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest rule that fits, else null.  Rules are few: each is an expression."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def grams(url: Column) -> Column:
    """Array of (context, next character) of a URL, its end included."""
    chars = F.concat(F.array_repeat(F.lit(BOS), ORDER), F.filter(F.split(url, ""), lambda c: c != ""), F.array(F.lit(EOS)))

    def all_of(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - 1 - ORDER), lambda i: F.struct(F.concat(*(F.get(a, i + k) for k in range(ORDER))).alias("h"), F.get(a, i + ORDER).alias("c")))

    return F.flatten(F.transform(F.array(chars), all_of))


def model(urls: DataFrame) -> DataFrame:
    """(h, c, gain long, n): log-probability of c after h under accepted less that under rejected, in micro-nats, for every gram of all URLs, and its places.

    ``urls`` has url and label (1 accepted, 0 rejected, null neither).  Counts of shorter contexts are sums of those of longer ones, so URLs are
    taken apart once.  What it holds grows with the distinct grams of the corpus.
    """
    one = urls.select(F.explode(grams(F.col("url"))).alias("g"), "label").groupBy("g.h", "g.c")
    full = materialise(one.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"), F.count("*").alias("n")), "grams")
    letters = full.select("c").distinct().count()
    below: DataFrame | None = None
    for k in range(ORDER + 1):
        level = full.groupBy(F.substring("h", ORDER - k + 1, k).alias("h"), "c").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        around = level.groupBy("h").agg(*(f(f"n{x}").alias(f"{y}{x}") for x in (1, 0) for f, y in ((F.sum, "t"), (lambda c: F.count_if(F.col(c) > 0), "d"))))
        if below is None:
            lower = level.withColumns({"q1": F.lit(1.0 / max(letters, 1)), "q0": F.lit(1.0 / max(letters, 1))})
        else:
            short = below.select(F.col("h").alias("hs"), F.col("c").alias("cs"), F.col("p1").alias("q1"), F.col("p0").alias("q0"))
            lower = level.join(short, (F.substring("h", 2, k) == F.col("hs")) & (F.col("c") == F.col("cs")))
        both = lower.join(around, "h")
        p = {f"p{x}": F.when(F.col(f"t{x}") > 0, (F.col(f"n{x}") + F.col(f"d{x}") * F.col(f"q{x}")) / (F.col(f"t{x}") + F.col(f"d{x}"))).otherwise(F.col(f"q{x}")) for x in (1, 0)}
        table = materialise(both.select("h", "c", *(v.alias(n) for n, v in p.items())), f"order{k}")
        discard(below)
        below = table
    gains = below.select("h", "c", F.round((F.log("p1") - F.log("p0")) * MICRO).cast("long").alias("gain"))
    out = materialise(gains.join(full.select("h", "c", "n"), ["h", "c"]), "model")
    discard(full, below)
    return out


def scored(urls: DataFrame, gains: DataFrame) -> DataFrame:
    """``urls`` (uid, url, ...) with score: micro-nats a character.  While the model is within the broadcast bound each URL's grams are summed in the task that
    takes it apart; beyond it grams that most URLs share are still looked up where they are."""
    each = attach(urls.select("uid", F.explode(grams(F.col("url"))).alias("g")).select("uid", "g.h", "g.c"), gains, ["h", "c"], weight="n")
    sums = each.groupBy("uid").agg(F.expr("sum(gain) div count(*)").alias("score"))
    return urls.join(sums, "uid", "left")


def calibrate(held: DataFrame) -> int:
    """The threshold, in micro-nats, that best parts accepted from rejected among held-out (score, label): the share of accepted at or above it
    plus the share of rejected below it.  Works on bins, whose number the probabilities bound.  0 if a class has no URL."""
    bins = held.where("score is not null").groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("r"))
    found = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "a", "r"))).alias("b"), F.sum("a").alias("a"), F.sum("r").alias("r"))
    best = F.expr("aggregate(b, named_struct('below_r', 0L, 'below_a', 0L, 'gain', cast(-1 as double), 'at', 0L), (s, x) -> named_struct('below_r', s.below_r + x.r, 'below_a', s.below_a + x.a, 'gain', greatest(s.gain, (a - s.below_a) / a + s.below_r / r), 'at', if((a - s.below_a) / a + s.below_r / r > s.gain, x.bin, s.at)), s -> s.at)")
    row = found.where("a > 0 and r > 0").select(best.alias("at")).first()
    return 0 if row is None else row["at"] * BIN


def filter_urls(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``df``: the id, host, path, rule (null if none fits), verdict, score (micro-nats a character).

    A null URL is empty: its host and path are empty and it is judged by the model like any other.  Repeated URLs count each time.  Where rules accept or reject
    nothing, the models are equal and every other URL is allowed.  Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    parsed = df.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parsed.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    decided = F.lit(None).cast("int")
    for r in rules:
        decided = F.when(F.col("rule") == r.text, F.lit(int(r.verdict == "allow"))).otherwise(decided)
    table = materialise(judged.withColumn("label", decided).withColumn("uid", F.monotonically_increasing_id()), "urls")
    held = fold_of(F.col("url")) == 0
    seen = table.select("url", F.when(~held, F.col("label")).alias("label"))
    labels = seen.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("r")).first()
    if labels["a"] and labels["r"]:
        gains = model(seen)
        out = materialise(scored(table, gains), "scored")
        discard(gains)
        threshold = calibrate(out.where(held & F.col("label").isNotNull()))
    else:
        out, threshold = table.withColumn("score", F.lit(0).cast("long")), 0
    verdict = F.when(F.coalesce("label", (F.col("score") >= threshold).cast("int")) == 1, "allow").otherwise("block")
    return out.select("id", "url", "host", "path", "rule", "label", "score", verdict.alias("verdict"))
