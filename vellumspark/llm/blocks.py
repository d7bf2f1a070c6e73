"""Whole groups compared in blocks: any group is dealt out as pairs of bounded blocks, and a task sees one pair of blocks.

Tasks give one row a member (links, and the smallest member reached), never a row a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, grouped, local_roots, map_arrow, materialise


#: Members from which a group is searched for a core, members that its pivot is made of, and blocks that the rest of such a group has at least where
#: blocks of 64 rows allow it, so that its pairs spread over tasks.
CORE_FROM, CORE_SAMPLE, FEWEST_BLOCKS, FEWEST_ROWS = 512, 1024, 24, 64


def block_rows(members: DataFrame, group: str, size: str, member: str, per_block: int, keep: list[str]) -> DataFrame:
    """``members`` once for each pair of blocks that its block is in: (group, a, b, blk, *keep).  A group of ``size`` rows has size / per_block blocks."""
    n = F.ceil(F.col(size) / F.lit(per_block)).cast("int")
    return paired(members, F.pmod(F.xxhash64(member), n.cast("long")).cast("int"), F.sequence(F.lit(0), n - 1), group, keep)


def rim_rows(marked: DataFrame, group: str, member: str, per_block: int, keep: list[str]) -> DataFrame:
    """The same for groups with a core (columns core, n_core, n_rim): pairs of two blocks of the core are left out, so a group without a rim has no row."""
    rows = F.greatest(F.lit(min(FEWEST_ROWS, per_block)), F.least(F.lit(per_block), (F.col("n_core") + F.col("n_rim")) / F.lit(FEWEST_BLOCKS)))
    inner, outer = (F.ceil(F.col(c) / rows).cast("int") for c in ("n_core", "n_rim"))
    place = lambda n: F.pmod(F.xxhash64(member), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    all_rim = F.when(outer > 0, F.sequence(inner, inner + outer - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    others = F.when(F.col("core"), all_rim).otherwise(F.sequence(F.lit(0), inner + F.greatest(outer, F.lit(1)) - 1))
    return paired(marked, F.when(F.col("core"), place(inner)).otherwise(inner + place(outer)), others, group, keep)


def paired(members: DataFrame, blk: Column, others: Column, group: str, keep: list[str]) -> DataFrame:
    out = members.withColumn("blk", blk).withColumn("__other", F.explode(others))
    return out.select(group, F.least("blk", "__other").alias("a"), F.greatest("blk", "__other").alias("b"), "blk", *keep)


#: Links of rows to columns, as index arrays; the same rows twice where a block is compared with itself.
Linker = Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]]


def linked(rows: DataFrame, group: str, member: str, weight: str | None, linker: Linker) -> DataFrame:
    """(member, links, root) for members with links in some pair of blocks; ``links`` counts a partner by its weight."""

    def compute(table: pa.Table) -> pa.RecordBatch | None:
        ids = table.column(member).to_numpy()
        _, once = np.unique(ids, return_index=True)
        if once.size < ids.size:
            table = table.take(pa.array(once))
            ids = ids[once]
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        blk = table.column("blk").to_numpy()
        left = np.flatnonzero(blk == a)
        right = left if a == b else np.flatnonzero(blk == b)
        if not left.size or not right.size:
            return None
        x = table.take(pa.array(left))
        i, j = linker(x, x if a == b else table.take(pa.array(right)))
        if a == b:
            off = i != j
            i, j = i[off], j[off]
        i, j = left[i], right[j]
        if not i.size:
            return None
        w = np.ones(ids.size, np.int64) if weight is None else table.column(weight).to_numpy()
        links = np.zeros(ids.size, np.int64)
        np.add.at(links, i, w[j])
        if a != b:
            np.add.at(links, j, w[i])
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        root = ids[order][local_roots(ids.size, place[i], place[j])[place]]
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(root[hit])], [member, "links", "root"])

    return grouped(rows, [group, "a", "b"], compute, f"{member} long, links long, root long")


#: From a bounded sample of a group's members, a value of their kind that they lie around; whether members lie so near to it that any two of them link.
Pivot = Callable[[pa.Table], bytes]
Near = Callable[[pa.RecordBatch], list[bool]]


def verified(members: DataFrame, group: str, size: str, member: str, weight: str, per_block: int, keep: list[str], linker: Linker, pivot: Pivot, near: Near) -> DataFrame:
    """:func:`linked` for whole groups; ``members`` is a written table.

    Distances obey the triangle inequality: members within half the linking distance of any one point all link with one another.  In a group of over CORE_FROM
    members such a core is counted without comparing its pairs, and only pairs with a member outside it are compared, so a tight group costs time in
    proportion to its size.  The result is that of comparing all pairs, whatever the size.
    """
    parts = linked(block_rows(members.where(F.col(size) <= CORE_FROM), group, size, member, per_block, keep), group, member, weight, linker)
    large = members.where(F.col(size) > CORE_FROM)
    if large.isEmpty():
        return parts

    def centre(table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([table.column(group)[0].as_py()], pa.int64()), pa.array([pivot(table)], pa.binary())], [group, "pivot"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(near(b), pa.bool_())], [*names, "core"])

    sample = large.where(F.pmod(F.xxhash64(member), F.ceil(F.col(size) / CORE_SAMPLE)) == 0)
    pivots = materialise(grouped(sample, [group], centre, f"{group} long, pivot binary"), "pivots")
    names = large.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.schema) + ", core boolean"
    marked = materialise(map_arrow(attach(large, pivots, [group]).select(*names, "pivot"), judge, schema), "marked")
    discard(pivots)
    counts = [F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rim"), F.sum(F.when(F.col("core"), F.col(weight))).alias("all"), F.min(F.when(F.col("core"), F.col(member))).alias("root")]
    known = attach(marked, materialise(marked.groupBy(group).agg(*counts), "cores"), [group])
    within = known.where("core and n_core > 1").select(member, (F.col("all") - F.col(weight)).cast("long").alias("links"), "root")
    across = linked(rim_rows(known, group, member, per_block, keep), group, member, weight, linker)
    return parts.unionByName(across).unionByName(within)
