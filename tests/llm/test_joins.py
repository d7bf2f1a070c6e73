import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import embed_dedup, jaccard_join
from vellumspark.llm.common import components


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(40)] + [(500, 500)] + [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == closure(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- embeddings


def brute_vectors(vectors, threshold=0.9):
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v) / math.hypot(*v) if k else None for v, k in zip(vectors, ok, strict=True)]
    n = len(vectors)
    return [(i, j) for i in range(n) for j in range(i) if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.standard_normal((300, 16))]
    for size in (2, 3, 40, 90):
        base = rng.standard_normal(16)
        vectors += [list(map(float, base + 0.12 * rng.standard_normal(16))) for _ in range(size)]
    vectors += [vectors[0]] * 3 + [[1e200] * 16, [2e200] * 16, [1.0, 2.0], [2.0, 4.0], None, [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, []]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, kept string")
    links = brute_vectors(vectors)
    degree = np.bincount(np.array(links).ravel(), minlength=len(vectors))
    root = closure(range(len(vectors)), links)
    rows = {r["vec_id"]: r for r in embed_dedup.near_vectors(df).collect()}
    assert len(rows) == len(vectors)
    found = sum(r["n_links"] for r in rows.values())
    assert found <= 2 * len(links) and found >= 0.9 * 2 * len(links)
    assert sum(rows[i]["component_id"] == root[i] for i in root) >= 0.98 * len(root)
    assert all(rows[i]["n_links"] <= degree[i] and rows[i]["kept"] == (rows[i]["component_id"] == i) for i in rows)


def test_a_hot_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(12)
    vectors = [list(map(float, base + 0.02 * rng.standard_normal(12))) for _ in range(100)]
    df = spark.createDataFrame([(i + 7, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = embed_dedup.near_vectors(df).collect()
    assert all(r["n_links"] == 99 and r["component_id"] == 7 for r in rows) and sum(r["kept"] for r in rows) == 1


@pytest.mark.parametrize(("cosine", "block"), [(0.7, 16), (0.8, 1024), (0.8, 16)])
def test_dense_regions_reach_the_recall(spark, monkeypatch, cosine, block):
    monkeypatch.setattr(embed_dedup, "PER_BLOCK", block)  # small blocks: more passes are cheaper than all pairs
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    hot = unit(math.sqrt(cosine) * centre + math.sqrt(1 - cosine) * unit(rng.standard_normal((1500, 64))))
    aside = rng.standard_normal((200, 64))
    aside = unit(aside - (aside * hot[:200]).sum(axis=1, keepdims=True) * hot[:200])
    x = np.concatenate([hot, 0.91 * hot[:200] + math.sqrt(1 - 0.91**2) * aside, unit(rng.standard_normal((3000, 64)))])
    links = np.argwhere(np.tril(x @ x.T >= 0.9, -1))
    rows = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = sum(rows[i]["component_id"] == rows[j]["component_id"] for i, j in links.tolist())
    assert len(links) >= 200 and found >= 0.95 * len(links)


@pytest.mark.parametrize("partitions", [4, 97])
def test_isolated_pairs_are_found_whatever_the_partitions(spark, partitions):
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((13_000, 64)))
    aside = rng.standard_normal((1000, 64))
    aside = unit(aside - (aside * x[:1000]).sum(axis=1, keepdims=True) * x[:1000])
    x = np.concatenate([x, 0.902 * x[:1000] + math.sqrt(1 - 0.902**2) * aside])
    ids = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "vec_id long, b binary").repartition(4)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        vectors = ids.mapInPandas(lambda parts: (p.assign(embedding=[np.frombuffer(b) for b in p.b]).drop(columns="b") for p in parts), "vec_id long, embedding array<double>")
        rows = embed_dedup.near_vectors(vectors).select("vec_id", "component_id", "n_links").toPandas().sort_values("vec_id")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (rows.component_id.to_numpy()[13_000:] == np.arange(1000)).mean() >= 0.95 and rows.n_links.sum() <= 2000


def test_sketches_of_pairs_at_the_threshold_are_close():
    assert embed_dedup.sketch_limit(0.9) == 20 and embed_dedup.sketch_limit(0.5) < embed_dedup.SKETCH
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((2, 500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    z = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    planes = rng.standard_normal((32, embed_dedup.SKETCH))
    assert ((x @ planes > 0) != (z @ planes > 0)).sum(axis=1).max() <= embed_dedup.sketch_limit(0.9)


def test_vectors_empty_table_and_passes(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_vectors(df).collect() == []
    assert embed_dedup.passes_for(10) >= 2 and embed_dedup.passes_for(10**8) < 200


# --- Jaccard


def brute_texts(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(60):
        texts.append(" ".join([*(word() for _ in range(rng.randint(20, 120))), *(passage if rng.random() < 0.4 else [])]))
    for size in (2, 3, 30, 120):
        base = [word() for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + [None, "", " \n", "one two", "one  two", "one two three", "a b c d e", "a b c d f", "long " * 20_000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_texts_against_brute_force(spark, monkeypatch, small):
    if small:  # deep trees and many blocks
        monkeypatch.setattr(jaccard_join, "LIMIT", 4)
        monkeypatch.setattr(jaccard_join, "BLOCK_SAMPLES", 8)
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    texts = corpus()
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_links int, rep string")
    links = brute_texts(texts)
    degree = np.bincount(np.array(links).ravel(), minlength=len(texts))
    root = closure(range(len(texts)), links)
    rows = {r["doc_id"]: r for r in jaccard_join.similar_texts(df).collect()}
    assert {i: (r["class_id"], r["n_links"], r["kept"]) for i, r in rows.items()} == {i: (root[i], degree[i], root[i] == i) for i in root}
    if not small:
        kept = jaccard_join.keep_one(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))


def test_texts_empty_table_null_and_repeated_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar_texts(df).collect() == [] and jaccard_join.keep_one(df).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "other words in here now")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similar_texts(odd).collect()), key=repr)
    assert len(rows) == 4 and sorted(n for _, _, n in rows) == [0, 2, 2, 2]


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.999) > jaccard_join.runs_for(0.9) >= 2


def test_pairs_in_a_large_loose_bucket_are_found(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIMIT", 4)
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    shared = [word() for _ in range(120)]  # half of every text, so that no two of them link by it alone
    bases = [[word() for _ in range(120)] for _ in range(150)]
    texts = [" ".join([*shared, *own]) for own in bases] + [" ".join([*shared, *own[:60], "x", *own[61:]]) for own in bases]
    rows = jaccard_join.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r["class_id"] == r["doc_id"] - 150 for r in rows if r["doc_id"] >= 150) == 150 and all(r["n_links"] == 1 for r in rows)


def test_shingles_of_few_words():
    assert jaccard_join.shingles("").size == 0 and jaccard_join.shingles("a b").size == 1
    assert jaccard_join.shingles("a b c d e f").size == 2 and (jaccard_join.shingles("a b") != jaccard_join.shingles("b a")).all()


def test_copies_have_no_pairs(spark):
    df = spark.createDataFrame([(i, "the same words in every single document") for i in range(500)], "doc_id long, text string")
    got = jaccard_join.similar_texts(df).agg(F.min("n_links"), F.max("n_links"), F.max("class_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (499, 499, 0, 1)


def test_cores_of_tight_groups_are_counted_without_pairs(spark, monkeypatch):
    from vellumspark.llm import blocks

    monkeypatch.setattr(blocks, "CORE_FROM", 10)
    monkeypatch.setattr(blocks, "CORE_SAMPLE", 20)
    texts = corpus()
    links = brute_texts(texts)
    degree = np.bincount(np.array(links).ravel(), minlength=len(texts))
    root = closure(range(len(texts)), links)
    rows = jaccard_join.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {i: (root[i], degree[i]) for i in root}
    rng = np.random.default_rng(9)
    vectors = []
    for spread in (0.01, 0.1, 0.3):
        base = rng.standard_normal(12)
        vectors += [list(map(float, base + spread * rng.standard_normal(12))) for _ in range(60)]
    pairs = brute_vectors(vectors)
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(vectors))
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(len(vectors))] == degree.tolist()
