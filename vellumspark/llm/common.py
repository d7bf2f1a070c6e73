"""Shared plumbing: shared-folder tables, size-checked joins, components, grouped passes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shipping

#: Rows, and bytes as they lie in memory, up to which a table written beforehand may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A key is hot if it has over one in so many of a table's rows; there are at most so many of them.
HOT = 1000
SETTING = "spark.checkpoint.dir"
#: Bytes of an Arrow batch while tables are written.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: What workers call at the end of a task.
CACHES: list[Callable[[], None]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset a local one in local mode (tests), and an error on a cluster."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vellum/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in Arrow batches of a few MB while plans are made and run in here, so that a task holds little beside its group."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path  # type: ignore[attr-defined]
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_vellum_path", None)
        if path:
            delete(table.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from the columns of ``df``, whose case does not count."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((width(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda acc, x: acc + width(x, kind.elementType)), F.lit(24).cast("long"))
    return F.lit(8).cast("long")


def fits(table: DataFrame) -> bool:
    """Whether a table written beforehand is within the bounds of rows and bytes for a broadcast."""
    size = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(32).cast("long"))
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def bounded(table: DataFrame) -> DataFrame:
    """``table`` (written beforehand) marked for broadcast if its measured size is within the bounds."""
    return F.broadcast(table) if fits(table) else table


def attach(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", weight: str | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with a written ``table`` of unique ``keys``, so that no key is gathered in one task.

    A small table is broadcast.  Of a larger one only the hot keys are, of which there are at most HOT, and their rows stay where they are; all others are
    joined by a shuffle.  ``weight`` names the column that holds how many of the rows a key has, which is then not counted again but for its sum.
    Rows with a null key match nothing and are not shuffled.
    """
    if fits(table):
        return rows.join(F.broadcast(table), keys, how)
    if weight is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    else:
        counts = table.select(*keys, F.col(weight).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(materialise(counts.where(F.col("__n") > max(1, total // HOT)).select(*keys), "hot"))
    often = rows.join(hot, keys, "left_semi").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how)
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    rest = rows.where(~null).join(hot, keys, "left_anti").join(table.join(hot, keys, "left_anti"), keys, how)
    out = often.unionByName(rest)
    if how == "left":
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in keys]
        out = out.unionByName(rows.where(null).select("*", *more))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the trees by pointer jumping, and
    contracts the edges to the roots, so the rounds grow with the logarithm of the longest path.
    Loops and repeated edges are harmless; an empty table gives an empty result.
    """
    e = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("to")))
        p = materialise(both.groupBy("node").agg(F.least("node", F.min("to")).alias("root")), "hook")
        while True:
            q = p.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = materialise(attach(p.select("node", "root"), q, ["root"]).select("node", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")), "jump")
            discard(p)
            p = jumped
            if p.where("moved").isEmpty():
                break
        maps.append(p)
        up = p.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        vp = p.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        smaller = attach(attach(e, up, ["u"]), vp, ["v"]).where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        nxt = materialise(smaller, "edges")
        discard(e)
        e = nxt
    discard(e)
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = maps[0].select("node", "root")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("above"))
        out = attach(out, step, ["root"], "left").select("node", F.coalesce("above", "root").alias("root"))
    return out


def grouped(df: DataFrame, keys: list[str], compute: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Call ``compute`` with the rows of each group of ``keys``; groups must be bounded by how keys are made.

    Rows are dealt out by ranges of the keys, so that tasks get like numbers of rows, sorted within the partition and cut at the key's
    changes in a stream: a task holds one group at a time (plus an Arrow batch).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        last: tuple | None = None
        out: list[pa.RecordBatch] = []

        def flush() -> None:
            nonlocal rest
            if rest:
                got = compute(pa.concat_tables(rest))
                if got is not None and got.num_rows:
                    out.append(got)
                rest = []

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change).tolist()
            first = tuple(c[0] for c in cols)
            if last is not None and first != last:
                flush()
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if a:
                    flush()
                rest.append(table.slice(a, b - a))
            last = tuple(c[-1] for c in cols)
            if sum(x.num_rows for x in out) > 4096:
                yield from out
                out.clear()
        flush()
        yield from out

    return map_arrow(df.repartitionByRange(*keys).sortWithinPartitions(*keys), run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers have this package and, idle between tasks, hold no memory that they do not need."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return shipping.map_arrow(df, lean, schema)


def release() -> None:
    """Give what caches and memory pools hold back to the machine."""
    for clear in CACHES:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over the links a-b."""
    root = np.arange(n)
    while a.size:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[root])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root
