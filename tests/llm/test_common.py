import pytest
from pyspark.sql import functions as F

from vellumspark.llm import common, jaccard_join, line_dedup, pii, quality, sharding


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Nothing is small enough for a broadcast, neither here nor for Spark."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("weight", [None, "n"])
def test_hot_and_null_keys_are_spread(spark, shuffled, how, weight):
    rows = spark.range(24_000, numPartitions=4).selectExpr("id", "case when id % 3 = 0 then 7 when id % 3 = 1 then id when id % 2 = 0 then null else -id end as k")
    counts = common.materialise(rows.groupBy("k").agg(F.count("*").alias("n")).where("k >= 0").withColumn("twice", F.col("k") * 2), "counts")
    got = common.attach(rows, counts if weight else counts.drop("n"), ["k"], how, weight)
    want = rows.join(F.broadcast(counts if weight else counts.drop("n")), ["k"], how)
    cols = ["id", "k", "twice"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, want.select(*cols).collect()), key=repr)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    table = common.materialise(spark.createDataFrame([(i, "x" * 1000, [1, 2, 3], [("a", b"b")]) for i in range(50)], "i int, s string, a array<int>, b array<struct<c:string,d:binary>>"), "wide")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 60_000)
    assert common.fits(table)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 50_000)
    assert not common.fits(table) and common.fits(table.limit(0))


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


LINE = "every page of this site ends with the very same notice"


def test_lines_and_copies_with_hot_keys(spark, shuffled, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    rows = [(i, f"own line number {i} with enough words\n{LINE}" if i % 3 else LINE, f"s{i % 7}") for i in range(60)] + [(100 + i, "", "s1") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df).collect()}
    assert out == {i: int(0 < i < 100) for i, _, _ in rows}
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar_texts(df).collect()}
    assert classes == {i: (i, 0) if i >= 100 or i % 3 else (0, 19) for i, _, _ in rows}


def test_columns_with_clashing_names_stay(spark):
    names = ["__id", "__key", "__spans", "__merged", "__bad", "__out", "__slot", "__shard", "__N", "v", "row", "votes", "uid", "k1", "a", "n"]
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(80))
    rows = [(i, f"{text(i)}\n{LINE}\nu{i}@mail.example.com", f"s{i}", *([f"x{i}"] * len(names))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for make, more in ((line_dedup.dedup_lines, ["n_lines", "n_removed"]), (jaccard_join.keep_one, []), (pii.redact, []), (quality.keep_quality, []), (lambda d: sharding.assign_shards(d, ["doc_id"], ["a", "b"], 101).select(*d.columns, "shard"), ["shard"])):
        got = make(df)
        assert got.columns == df.columns + more
        kept = got.collect()
        assert len(kept) == 4 and all(r[n] == f"x{r['doc_id']}" for r in kept for n in names)
