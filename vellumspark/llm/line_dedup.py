"""Operator 7, line dedup: boilerplate lines by distinct-site spread.  DataFrame functions only.

A HyperLogLog sketch of the sites of each line is merged by aggregation.  Lines whose estimate lies clearly above the threshold are
boilerplate; those near it get an exact distinct count.  Of a boilerplate line the document with the smallest id keeps its copies; all
other documents lose theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded, discard, fresh, materialise
from .quality import let

SKETCH_BITS = 12
BLANK = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    """128 bits that stand for a line without the blanks around it."""
    return let(F.btrim(line, F.lit(BLANK)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), F.size(F.split(x, r"[ \t]+")).alias("words")))


def lines_of(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, site, a, b, words) for each line that is not blank."""
    lines = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{site_col}`").alias("site"), F.explode(F.transform(lines, line_key)).alias("k")).select("id", "site", "k.a", "k.b", "k.words")


def boilerplate(lines: DataFrame, min_sites: int, short_words: int, short_sites: int, long_words: int, long_sites: int) -> DataFrame:
    """(a, b, keeper, n: places) of lines on at least min_sites sites; lines of fewer than short_words words need short_sites, those of long_words and more
    long_sites.  Null sites don't count."""
    need = F.when(F.col("words") < short_words, F.lit(short_sites)).when(F.col("words") >= long_words, F.lit(long_sites)).otherwise(F.lit(min_sites))
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(SKETCH_BITS)).alias("sketch"), F.min("id").alias("keeper"), F.min("words").alias("words"), F.count("*").alias("n"))
    # an estimate is off by over a tenth, or by one where counts are small, practically never: 1.04 / sqrt(2**12) is 1.6 %
    judged = spread.where(F.col("n") >= need).select("a", "b", "keeper", "words", "n", F.hll_sketch_estimate("sketch").alias("about"), need.alias("need"))
    judged = materialise(judged.where(F.col("about") >= F.col("need") - F.greatest(F.lit(1.0), 0.1 * F.col("need"))), "spread")
    clear = F.col("about") > F.col("need") + F.greatest(F.lit(1.0), 0.1 * F.col("need"))
    near = judged.where(~clear)
    exact = attach(lines, near.select("a", "b", "need", "n"), ["a", "b"], weight="n").groupBy("a", "b", "need").agg(F.count_distinct(F.col("site").cast("string")).alias("sites"))
    sure = exact.where("sites >= need").select("a", "b")
    out = judged.where(clear).select("a", "b", "keeper", "n").unionByName(near.join(sure, ["a", "b"]).select("a", "b", "keeper", "n"))
    done = materialise(out, "boilerplate")
    discard(judged)
    return done


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 3,
    short_words: int = 5,
    short_sites: int = 8,
    long_words: int = 50,
    long_sites: int | None = None,
) -> DataFrame:
    """``df`` with boilerplate lines taken out of its text, plus ``n_lines`` and ``n_removed`` (long; lines that are not blank).

    Lines are compared without the blanks around them; blank lines stay.  Rows that share an id count as one document; a null id never
    keeps a line unless all its holders have null ids, then the rows with null ids keep it.  Null text stays null with 0 lines, null
    sites count for nothing, an empty table gives an empty result; input columns named n_lines or n_removed are replaced, others of any name stay.  Lines of long_words words
    and more need long_sites sites, min_sites unless it is given.
    """
    lines = materialise(lines_of(df, id_col, text_col, site_col), "lines")
    bad = boilerplate(lines, min_sites, short_words, short_sites, long_words, min_sites if long_sites is None else long_sites)
    bad_id, bad_lines, made_col = fresh(df, "__id", "__bad", "__out")
    hits = attach(lines, bad, ["a", "b"], weight="n").where("not (id <=> keeper)").groupBy(F.col("id").alias(bad_id)).agg(F.collect_set(F.struct("a", "b")).alias(bad_lines))
    hits = materialise(hits, "hits")
    discard(lines, bad)
    text, gone = F.col(f"`{text_col}`"), F.col(bad_lines)
    stays = lambda x: ~F.array_contains(gone, let(line_key(x), lambda k: F.struct(k["a"], k["b"])))
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    count = lambda t: F.size(F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")).cast("long")
    # the text after and the counts are bound once, so that no expression is computed twice
    out = let(kept, lambda k: F.struct(k.alias("text"), count(text).alias("n"), count(k).alias("left")))
    joined = df.drop("n_lines", "n_removed").join(bounded(hits), F.col(f"`{id_col}`").eqNullSafe(F.col(bad_id)), "left").withColumn(made_col, F.transform(F.array(out), lambda x: x))
    made = F.col(made_col)[0]
    names = [F.col(f"`{c}`") if c != text_col else made["text"].alias(c) for c in df.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*names, made["n"].alias("n_lines"), (made["n"] - made["left"]).alias("n_removed"))
