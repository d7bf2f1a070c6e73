import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from vellumspark.llm import bpe, queries
from vellumspark.llm.queries import vocabulary

from .test_joins import brute_texts, closure
from .test_pii_quality_lines import brute_lines, brute_spans, prose, quality_texts

DATA = "/root/testdata/sf0.001"


def sample():
    import random

    rng = random.Random(21)
    good, marked, looped, odd = quality_texts()
    near = prose(rng, 200)
    copies = [near, near, near.replace(near.split()[10], "changed")]
    shared = "every page of this site ends with the very same notice"
    mixed = [g + "\n" + shared for g in good[:20]]
    mail = [good[30] + f" write to some{i}@mail.example.com or 10.0.0.{i} " + prose(rng, 80) for i in range(5)]
    return [*good[20:30], *marked, *looped, *[o for o in odd if o is None or len(o) < 1000], *copies, *[good[45]] * 4, *mixed, *mail]


def redacted(text):
    spans = sorted((a, b, k) for k, a, b in brute_spans(text))
    merged = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in reversed(merged):
        text = text[:a] + f"[{('email', 'ip', 'card', 'phone')[k]}]" + text[b:]
    return text


def test_run_against_brute_force(spark, tmp_path):
    texts = sample()
    rows = [(i, t, "en", f"s{i % 6}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    good, marked, looped, _ = quality_texts()
    bad = {*marked, *looped}
    kept = [(i, t, s) for i, t, _, s, _ in rows if t and t not in bad and len(t.split()) >= 50]
    lined = [(i, t) for (i, t, n, gone) in brute_lines(kept) if gone == 0 or gone < n]
    links = brute_texts([t for _, t in lined])
    root = closure(range(len(lined)), links)
    clean = {lined[i][0]: redacted(lined[i][1]) for i in root if root[i] == i}
    codec = bpe.Codec(vocabulary())
    got = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    assert {i: codec.decode(x[:-4]) for i, x in got.items()} == clean
    assert any("[email]" in t and "[ip]" in t for t in clean.values()) and len(clean) < len(lined) < len(kept) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_over_the_whole_table(spark, name):
    table = {"op3": "pages", "op4": "pages", "op6": "embeddings"}.get(name.split("_")[0], "documents")
    df = __spark_entry__.queries()[name](spark, DATA)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(table, "doc_id")
    want = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert len({r[cols.index(key)] for r in rows}) == want and (len(rows) == want or name.startswith("op2"))
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        got = con.execute(queries.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(rows, key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in got.fetchall()), key=repr)
