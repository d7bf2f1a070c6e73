"""Operator 8, n-gram Jaccard self-join by chosen paths.

A text's 5-word shingles are embedded as 64 minwise samples.  In each run every node of a tree picks one or two of the samples by its own random choice
(5/4 on average, one over the similarity), and texts follow the path of the values that they hold there, so that similar texts keep meeting however deep the tree
goes.  Small buckets are compared by brute force at once; large ones are split again, and at the last depth compared in blocks.  Runs are repeated
until the target recall.  Groups that come out are verified on whole shingle sets, all pairs, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import verified
from .common import CACHES, attach, bounded, components, discard, fresh, map_arrow, materialise

WORDS, SAMPLES, DEPTH, LIMIT, RECALL, SEED = 5, 64, 4, 64, 0.999, 23
#: Threshold 0.8 as a fraction, so that it is compared in whole numbers.
OVER, UNDER = 4, 5
#: Equal samples below which a pair is not a candidate: four standard deviations under the threshold.
MIN_EQUAL = int(SAMPLES * (0.8 - 4 * math.sqrt(0.8 * 0.2 / SAMPLES)))
#: Rows of a block on either side: of samples, of whole shingle sets.
BLOCK_SAMPLES, BLOCK_SETS = 256, 256
CACHE_WORDS = 100_000
_rng = np.random.default_rng(SEED)
MULTIPLY = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = WordHashes()
CACHES.append(_words.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a text of fewer words is one shingle, a text without words none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        acc += h[k : len(words) - n + 1 + k] * STEP[k]
    return np.unique(mixed(acc))


def minwise(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 8192):
        out = np.minimum(out, ((s[None, at : at + 8192] * MULTIPLY[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32).view(np.int32)


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, size, sig): 128 bits that stand for the text, the number of its shingles, and its samples."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), *text_keys(text), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sigs = [], []
            for t in b.column("text"):
                s = shingles(t.as_py())
                sizes.append(s.size)
                sigs.append(minwise(s))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, SAMPLES * (len(sigs) + 1), SAMPLES, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(sizes, pa.int64()), lists], ["doc_id", "k1", "k2", "size", "sig"])

    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, size long, sig array<int>")


def runs_for(recall: float = RECALL, depth: int = DEPTH, similarity: float = 0.8) -> int:
    """Runs until a pair at the threshold has shared a path to the last depth with probability ``recall``."""
    lost = 0.0
    for _ in range(depth):
        one = 1 - similarity + similarity * lost
        lost = 0.75 * one + 0.25 * one * one
    return math.ceil(math.log(1 - recall) / math.log(lost))


def children(path: Column, sig: Column) -> Column:
    """Paths one deeper: every node picks a sample, and one node in four a second one."""
    pick = lambda salt: F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(SAMPLES)).cast("int")
    down = lambda i: F.xxhash64(path, i, F.get(sig, i))
    more = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0
    return F.when(more, F.array(down(pick(1)), down(pick(2)))).otherwise(F.array(down(pick(1))))


def buckets(texts: DataFrame, runs: int) -> DataFrame:
    """(rep, path, n): texts in buckets of two and more that are small, or at the last depth."""
    out: list[DataFrame] = []
    roots = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(F.lit(SEED), r))
    live = texts.select("rep", "sig", F.explode(roots).alias("path"))
    for level in range(1, DEPTH + 1):
        step = materialise(live.select("rep", F.explode(children(F.col("path"), F.col("sig"))).alias("path")).distinct() if level > 1 else live.select("rep", F.explode(children(F.col("path"), F.col("sig"))).alias("path")), "paths")
        sizes = materialise(step.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path_sizes")
        met = materialise(attach(step, sizes, ["path"], weight="n"), "met")
        discard(step, sizes)
        if level == DEPTH:
            out.append(met)
            break
        out.append(met.where(F.col("n") <= LIMIT))
        big = met.where(F.col("n") > LIMIT)
        if big.isEmpty():
            break
        live = big.select("rep", "path").join(texts.select("rep", "sig"), "rep")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def alike(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose samples agree often enough to be candidates."""
    a, b = (t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES) for t in (x, y))
    same = np.zeros((len(a), len(b)), np.uint8)
    for k in range(SAMPLES):
        same += a[:, k][:, None] == b[:, k][None, :]
    return np.nonzero(same >= MIN_EQUAL)


def modal(t: pa.Table) -> bytes:
    """The most frequent value of each sample."""
    sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, SAMPLES)
    out = np.empty(SAMPLES, np.int32)
    for k in range(SAMPLES):
        values, counts = np.unique(sig[:, k], return_counts=True)
        out[k] = values[counts.argmax()]
    return out.tobytes()


def agreeing(b: pa.RecordBatch) -> list[bool]:
    """Whether texts differ from the pivot in so few samples that any two of them are candidates."""
    sig = b.column("sig").flatten().to_numpy().reshape(-1, SAMPLES)
    pivot = np.frombuffer(b"".join(b.column("pivot").to_pylist()), np.int32).reshape(-1, SAMPLES)
    return (2 * (sig != pivot).sum(axis=1) <= SAMPLES - MIN_EQUAL).tolist()


def overlapping(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose shingle sets have a Jaccard similarity of at least 4/5, counted exactly."""
    sets = [[np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()] for t in (x, y)]
    if x is y and len(sets[0]) == 2:
        a, b = sets[0]
        both = np.intersect1d(a, b, assume_unique=True).size
        return (np.array([0, 1]), np.array([1, 0])) if UNDER * both >= OVER * (a.size + b.size - both) else (np.zeros(0, int), np.zeros(0, int))
    sizes = [np.array([s.size for s in side]) for side in sets]
    sides = sets if x is not y else sets[:1]
    flat = np.concatenate([s for side in sides for s in side])
    owner = np.repeat(np.arange(sum(map(len, sides))), [s.size for side in sides for s in side])
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1  # a shingle of one text only is in no intersection
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, col = owner[use], column[inverse[use]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((len(sets[0]), len(sets[1])), np.int64)
    width = 8192
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [at, at + width])
        m = np.zeros((sum(map(len, sides)), width), np.float32)
        m[owner[lo:hi], col[lo:hi] - at] = 1
        left = m[: len(sets[0])]
        right = left if x is y else m[len(sets[0]) :]
        both += (left @ right.T).astype(np.int64)
    return np.nonzero(UNDER * both >= OVER * (sizes[0][:, None] + sizes[1][None, :] - both))


def consensus(t: pa.Table) -> bytes:
    """The shingles that most of the texts have, sorted."""
    values, counts = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]), return_counts=True)
    return values[2 * counts > t.num_rows].tobytes()


def close_to(b: pa.RecordBatch) -> list[bool]:
    """Whether texts are within half the linking distance of the pivot: a similarity of 9/10 for one of 4/5."""
    out = []
    for s, p in zip(b.column("set").to_pylist(), b.column("pivot").to_pylist(), strict=True):
        x, y = np.frombuffer(s, np.uint64), np.frombuffer(p, np.uint64)
        both = np.intersect1d(x, y, assume_unique=True).size
        out.append((2 * UNDER - 1) * (x.size + y.size - both) <= 2 * UNDER * both)
    return out


def shingle_sets(df: DataFrame, id_col: str, text_col: str, members: DataFrame) -> DataFrame:
    """(rep, grp, size, copies, set) of the texts that are ``members`` (rep, doc, k1, k2, grp, size, copies)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), *text_keys(text), text.alias("text"))
    # the id is part of the key: copies of a text are spread
    m = members.withColumnsRenamed({"k1": "m1", "k2": "m2"})
    only = src.join(bounded(m), (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("rep", "grp", "size", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "grp", "size", "copies")), pa.array(sets, pa.binary())], ["rep", "grp", "size", "copies", "set"])

    return map_arrow(only, run, "rep long, grp long, size long, copies long, set binary")


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row for each row of ``df``: doc_id, class_id (smallest doc_id reachable over links, itself included), n_links (other rows linked
    directly, copies included), kept (the row whose text stands for the class; of its copies those with the class's id).

    Two texts link if the Jaccard similarity of their 5-word shingle sets is 0.8 or more; words are parted by white space and compared as written.
    Equal texts are one text with copies.  A text of fewer than five words is one shingle; a text without words, or null, links with nothing, equal ones
    included.  Rows that share an id and a text are copies.  Other columns are not read; an empty table gives an empty result.
    """
    rows = materialise(signatures(df, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    # the copy with the smallest id stands for a text
    first = rows.where("size > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "uid")).alias("r"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    texts = materialise(first.select("k1", "k2", F.col("r.uid").alias("rep"), F.col("r.doc_id").alias("doc"), "copies", "sig"), "texts")
    met = buckets(texts, runs_for(recall))
    cand = materialise(met.join(texts.select("rep", "sig"), "rep").withColumn("one", F.lit(1).cast("long")), "bucketed")
    stars = verified(cand, "path", "n", "rep", "one", BLOCK_SAMPLES, ["rep", "sig", "one"], alike, modal, agreeing).select(F.col("rep").alias("u"), F.col("root").alias("v"))
    groups = materialise(components(stars).select(F.col("node").alias("rep"), F.col("root").alias("grp")), "candidate_groups")
    sizes = materialise(groups.groupBy("grp").agg(F.count("*").alias("size")), "group_sizes")
    members = materialise(attach(groups, sizes, ["grp"], weight="size").join(texts.drop("sig"), "rep"), "members")
    discard(groups, sizes, cand)
    sets = materialise(shingle_sets(df, id_col, text_col, members), "sets")
    if sets.count() > members.count():  # rows that repeat an id and its text
        sets = materialise(sets.dropDuplicates(["rep"]), "sets")
    checked = materialise(verified(sets, "grp", "size", "rep", "copies", BLOCK_SETS, ["rep", "copies", "set"], overlapping, consensus, close_to), "checked")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "root")
    known = materialise(texts.drop("sig").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "known")
    least = materialise(known.groupBy("root").agg(F.min("doc").alias("class_id")), "least")
    classed = materialise(attach(known, least, ["root"]).select("k1", "k2", "class_id", "doc", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    discard(checked, known, least, members, sets)
    out = attach(rows.select("doc_id", *(F.when(F.col("size") > 0, F.col(k)).alias(k) for k in ("k1", "k2"))), classed, ["k1", "k2"], "left", weight="copies")
    own = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the smallest id of their class, all columns, of any name, as they are.

    Rows without words, null text included, all stay; rows that share an id go or stay together; an empty table gives an empty result.
    """
    (other,) = fresh(df, "__id")
    drop = materialise(similar_texts(df, id_col, text_col).where("not kept").select(F.col("doc_id").alias(other)).distinct(), "dropped")
    return df.join(bounded(drop), F.col(f"`{id_col}`").eqNullSafe(F.col(other)), "left_anti")
