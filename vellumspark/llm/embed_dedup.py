"""Operator 6, embedding near-duplicates by sorted projection passes.

Every pass orders the vectors by a key of concatenated random-hyperplane bits and compares each with a bounded window of followers: first 64 bits of a
sketch, then, where these are close, the vectors, of which a pass ships a byte a component.  How many first bits a window covers is measured for each
vector; vectors that the passes don't bring to the recall, be it that their region is dense or that they lay at borders of partitions, where windows are
cut, get more passes among themselves, or are all compared with one another where that is cheaper.  Close pairs are united over all passes, each task
giving a star a group and not its pairs.  Within a group that came out, all pairs are then verified in double precision, in blocks, and counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_rows, linked, verified
from .common import attach, bounded, components, discard, local_roots, map_arrow, materialise

THRESHOLD, WINDOW, BITS, SKETCH, RECALL, SEED = 0.9, 256, 48, 64, 0.95, 11
#: Vectors of a group that a task compares at a time, on either side.
PER_BLOCK = 1024
#: Pairs of a window compared at a time.
STRETCH = 16384
#: Passes at most that dense regions get at a time.
MORE_PASSES = 16
#: What rounding may take off a cosine in single precision, and that of vectors with a byte a component (three standard deviations at the worst).
ROUNDING, ROUNDING_BYTES = 1e-4, 0.01


def even_bits(n: int, window: int) -> int:
    """First bits of a key that leave a window of vectors where vectors are spread evenly."""
    return max(1, math.ceil(math.log2(max(2, n / window))))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes until a pair just at the threshold has met in a window with the given probability, if vectors are spread evenly: it meets in a pass
    if its keys agree in as many first bits as leave a window of vectors."""
    bits = even_bits(n, window)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def sketch_limit(threshold: float) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, but for one pair in 10,000 (four standard deviations)."""
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH * p + 4 * math.sqrt(SKETCH * p * (1 - p)))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def byte_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of such bytes; ``data`` may be of any type."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def rows_of(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The rows of equal length that start at some places of a flat array."""
    return data[starts[:, None] + np.arange(length)]


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, v): v is the unit vector as doubles; dim is 0 for vectors that link with nothing."""
    src = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            sizes = x.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
            dims, parts = np.zeros(len(x), np.int64), []
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                m = rows_of(flat, starts[at], size)
                big = np.abs(m).max(axis=1)
                good = np.isfinite(m).all(axis=1) & (big > 0)
                m = m[good] / big[good, None]  # so that squares neither overflow nor vanish
                dims[at[good]] = size
                parts.append((at[good], m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]))
            ends = np.concatenate([[0], np.cumsum(dims)])
            out = np.empty(ends[-1], "<f8")
            for at, m in parts:
                out[ends[at][:, None] + np.arange(m.shape[1])] = m
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims.astype(np.int32)), byte_rows(out, ends * 8)], ["vec_id", "dim", "v"])

    return map_arrow(src, run, f"vec_id {src.schema['vec_id'].dataType.simpleString()}, dim int, v binary")


def projected(vectors: DataFrame, passes: int, first: int = 0) -> DataFrame:
    """(pass, dim, key, uid, sketch, v with a byte a component) for every pass; ``first`` is the number of passes made before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims, uids = b.column("dim").to_numpy(), b.column("uid").to_numpy()
            data, offsets = flat_bytes(b.column("v"))
            flat, starts = data.view("<f8"), offsets[:-1] // 8
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = rows_of(flat, starts[at], dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim, first] if first else [SEED, dim]).standard_normal((dim, passes * BITS)), np.random.default_rng([SEED + 1, dim]).standard_normal((dim, SKETCH))
                keys = ((x @ planes[dim][0]) > 0).reshape(len(at), passes, BITS) @ powers
                sketch = pa.array(np.packbits((x @ planes[dim][1]) > 0, axis=1).view(np.int64).ravel())
                small = byte_rows(np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8), np.arange(len(at) + 1) * dim)
                n = len(at)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(keys[:, p]), pa.array(uids[at]), sketch, small], ["pass", "dim", "key", "uid", "sketch", "v"])

    return map_arrow(vectors.where("dim > 0").select("uid", "dim", "v"), run, "pass int, dim int, key long, uid long, sketch long, v binary")


def window_stars(sorted_rows: DataFrame, threshold: float, window: int, even: int) -> DataFrame:
    """(u, v, depth): for vectors close to one another in a window of their partition, v is the smallest of those that u is linked with in a stretch of rows;
    for each row with whole windows on both sides, v is null and depth the number of first bits that surely bring a vector into a window with u.

    Where the row at the window's end links too, the windows are full of one group, and more than ``even`` bits don't count: groups are compared whole.
    """

    limit = sketch_limit(threshold)

    def stretch(p: np.ndarray, d: np.ndarray, key: np.ndarray, uid: np.ndarray, sketch: np.ndarray, v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a_all, b_all = [], []
        tight = np.zeros(uid.size, bool)
        data, offsets = flat_bytes(v)
        flat, starts = data.view(np.int8), offsets[:-1]
        for dim in np.unique(d).tolist():
            rows = np.flatnonzero(d == dim)
            x = rows_of(flat, starts[rows], dim).astype(np.float32)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            bits, pass_ = sketch.view(np.uint64)[rows], p[rows]
            for o in range(1, min(window, len(rows) - 1) + 1):
                hit = np.flatnonzero((np.bitwise_count(bits[o:] ^ bits[:-o]) <= limit) & (pass_[o:] == pass_[:-o]))
                for some in range(0, hit.size, STRETCH):
                    i = hit[some : some + STRETCH]
                    i = i[np.einsum("ij,ij->i", x[i], x[i + o]) >= threshold - ROUNDING_BYTES]
                    a_all.append(rows[i])
                    b_all.append(rows[i + o])
                    if o == window:
                        tight[rows[i]] = True
        whole = slice(window, max(window, uid.size - window))
        common = BITS - np.frexp((key[window:] ^ key[:-window]).astype(float))[1]
        common = np.where(tight[:-window], np.minimum(common, even - 1), common)
        common[(p[window:] != p[:-window]) | (d[window:] != d[:-window])] = -1
        depth = np.maximum(common[window:], common[: max(0, common.size - window)]) + 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
        if not a.size:
            return uid[:0], uid[:0], uid[whole], depth
        # one place a vector, though it has a row for each pass
        ids, place = np.unique(uid, return_inverse=True)
        root = local_roots(ids.size, place[a], place[b])
        moved = np.flatnonzero(root != np.arange(ids.size))
        return ids[moved], ids[root[moved]], uid[whole], depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if tail is None else pa.concat_tables([tail, t])
            if t.num_rows == 0:
                continue
            u, v, at, depth = stretch(*(t.column(c).to_numpy() for c in ("pass", "dim", "key", "uid", "sketch")), t.column("v").combine_chunks())
            if u.size + at.size:
                null = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([u, at])), pa.concat_arrays([pa.array(v), null(at.size, pa.int64())]), pa.concat_arrays([null(u.size, pa.int32()), pa.array(depth.astype(np.int32))])], ["u", "v", "depth"]
                )
            tail = t.slice(max(0, t.num_rows - 2 * window))

    return map_arrow(sorted_rows, run, "u long, v long, depth int")


def all_stars(vectors: DataFrame, threshold: float) -> DataFrame:
    """(u, v) for vectors linked with any other: all pairs of equal dimension compared, in blocks."""
    sizes = materialise(vectors.groupBy("dim").agg(F.count("*").alias("size")), "sizes")

    def linker(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(matrix(x) @ matrix(y).T >= threshold - ROUNDING)

    rows = block_rows(vectors.join(F.broadcast(sizes), "dim"), "dim", "size", "uid", PER_BLOCK, ["uid", "v"])
    return linked(rows, "dim", "uid", None, linker).select(F.col("uid").alias("u"), F.col("root").alias("v"))


def matrix(t: pa.Table) -> np.ndarray:
    return flat_bytes(t.column("v").combine_chunks())[0].view("<f8").reshape(t.num_rows, -1)


def found_stars(vectors: DataFrame, n: int, threshold: float, window: int, recall: float) -> DataFrame:
    """(u, v) of all passes over ``vectors`` (uid, dim, v; n rows).

    A pair meets in a pass if its keys agree in the depth measured at either of its vectors, so a vector whose depths give the recall has it for all of
    its pairs and is done; pairs that may still be missing have both vectors among the others, which go on by themselves.
    """
    at_threshold, goal = 1 - math.acos(threshold) / math.pi, math.log(1 - recall)
    passes, made, parts = passes_for(n, threshold, window, recall), 0, []
    left = vectors.withColumn("miss", F.lit(0.0))
    while True:
        rows = projected(left, passes, made)
        # the vector's own number ends the sort key, so that equal vectors can be dealt to several tasks
        ordered = rows.repartitionByRange("pass", "dim", "key", "uid").sortWithinPartitions("pass", "dim", "key", "uid")
        found = materialise(window_stars(ordered, threshold, window, even_bits(n, window)), "windows")
        made += passes
        parts.append(found.where("v is not null").select("u", "v"))
        # rows at the borders of partitions are not measured and count for nothing, so that the number of partitions takes nothing off the recall
        rate = F.sum(F.log(1 - F.least(F.lit(1 - 1e-9), F.pow(F.lit(at_threshold), "depth"))))
        rates = found.where("depth is not null").groupBy(F.col("u").alias("uid")).agg((rate / passes).alias("rate"))
        after = left.join(rates, "uid", "left").withColumn("miss", F.col("miss") + F.coalesce(F.col("rate") * passes, F.lit(0.0)))
        left = materialise(after.where(F.col("miss") > goal), "dense")
        m, wanted = left.agg(F.count("*"), F.avg((F.lit(goal) - F.col("miss")) / F.col("rate"))).first()
        if not m:
            break
        if wanted is None or math.ceil(m / PER_BLOCK) <= max(wanted, passes):
            parts.append(materialise(all_stars(left, threshold), "stars"))
            break
        passes = max(2, min(MORE_PASSES, math.ceil(wanted)))
        left = left.drop("rate")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``df``: vec_id, n_links (rows linked directly), component_id (smallest vec_id reachable), kept.

    Pairs of equal dimension link at a cosine of at least the threshold; null, zero or broken vectors link with nothing.  No pair below the threshold
    links.  Pairs are found with probability ``recall`` at the threshold, nearer pairs and those within larger groups more surely: all pairs of a group that came out
    are compared.  Repeated rows are vectors of their own; other columns are not read; an empty table gives an empty result.
    """
    table = materialise(unit_vectors(df, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n = table.where("dim > 0").count()
    stars = found_stars(table.where("dim > 0").select("uid", "dim", "v"), n, threshold, window, recall)
    found = materialise(components(stars).select(F.col("node").alias("uid"), F.col("root").alias("grp")), "groups")
    sizes = materialise(found.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    members = materialise(attach(found, sizes, ["grp"], weight="size").join(table.select("uid", "dim", "v"), "uid").withColumn("one", F.lit(1).cast("long")), "members")
    half = math.cos(math.acos(threshold) / 2 - 1e-9)

    def linker(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(matrix(x) @ matrix(y).T >= threshold)

    def middle(t: pa.Table) -> bytes:
        total = matrix(t).sum(axis=0)
        return (total / max(float(np.linalg.norm(total)), 1e-300)).tobytes()

    def near(b: pa.RecordBatch) -> list[bool]:
        (v, ends), (p, _) = flat_bytes(b.column("v")), flat_bytes(b.column("pivot"))  # a vector and its pivot are of one length
        owner = np.repeat(np.arange(b.num_rows), np.diff(ends) // 8)
        return (np.bincount(owner, v.view("<f8") * p.view("<f8"), b.num_rows) >= half).tolist()

    counted = materialise(verified(members, "grp", "size", "uid", "one", PER_BLOCK, ["uid", "v", "one"], linker, middle, near), "counted")
    links = counted.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(counted.select(F.col("uid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("uid"), "root")
    placed = materialise(table.select("uid", "vec_id").join(links, "uid", "left").join(roots, "uid", "left").select("uid", "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "root"), "placed")
    least = materialise(placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least")), "least")
    out = attach(placed, least, ["root"], "left")
    own = F.coalesce("least", "vec_id")
    discard(found, sizes, counted, members)
    return out.select("vec_id", "n_links", own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
