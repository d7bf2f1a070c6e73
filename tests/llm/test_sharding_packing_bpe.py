import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumspark.llm import bpe, packing, sharding
from vellumspark.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, ids string, `a b` int, slot string, id string"
LONG = "word " * 30_000 + "x" * 5_000


def docs(spark, *texts, first=0):
    rows = [(first + i, t, "clash", 1, "s", "other") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


# --- sharding


def brute_table(shards, slots):
    """Turn by turn, each shard's whole preference list written out."""
    lists = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    table: dict[int, int] = {}
    while len(table) < slots:
        for i, prefer in enumerate(lists):
            free = next((p for p in prefer if p not in table), None)
            if free is not None:
                table[free] = i
    return [table[p] for p in range(slots)]


def test_table_equals_the_written_out_lists():
    names = [f"s{i}" for i in range(7)]
    assert sharding.fill_table(names, 101) == brute_table(names, 101)


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = sharding.fill_table(names, 65537)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 65537)
    kept = [a == b for a, b in zip(table, fewer, strict=True) if a != 19]
    assert sum(kept) / len(kept) > 0.9


@pytest.mark.parametrize("bad", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(bad):
    with pytest.raises(ValueError):
        sharding.fill_table(*bad)


def test_rows_keep_together_and_clashing_columns_are_replaced(spark):
    df = docs(spark, "a", None, "", LONG).unionByName(docs(spark, "a", None)).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    names = ["x", "y", "z"]
    got = sharding.assign_shards(df, ["doc_id"], names, 101)
    rows = got.collect()
    assert len(rows) == 6 and got.columns.count("slot") == 1
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["shard"])
        part = "~" if r["doc_id"] is None else f"={r['doc_id']}"
        slot = int(hashlib.md5(part.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[brute_table(names, 101)[slot]])
    assert all(len(v) == 1 for v in by.values())
    assert sharding.assign_shards(df.limit(0), ["doc_id", "a b"], names, 101).collect() == []


def test_shards_are_written_apart(spark, tmp_path):
    df = docs(spark, *(f"t{i}" for i in range(50))).drop("a b")
    sharding.write_shards(df, ["doc_id"], ["x", "y", "z"], str(tmp_path / "out"), 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, ["doc_id"], ["x", "y", "z"], 101).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want and back.count() == 50


# --- packing


def test_cuts_lose_nothing_and_fill_their_class():
    for n in range(1, 3000):
        parts = packing.cuts(n)
        assert sum(parts) == n and all(1 <= p <= 1024 for p in parts) and len(parts) <= n // 1024 + 5
        for p in parts:
            k = packing.class_of(p, 1024)
            assert p * k <= 1024 and (k >= 64 or p > 1024 // (k + 1))


def check_packing(rows, encoded, capacity=1024):
    """Every id once, in order, sequences gapless; returns the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(encoded)
    for doc, pieces in by_doc.items():
        want = np.array([*encoded[doc], 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            data = want[at : at + r["length"]].tobytes()
            assert bytes(r["ids"]) == data and r["ids_crc32"] == zlib.crc32(data)
            at += r["length"]
        assert at == len(want)
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad / (pad + total)


def test_packing_whole_documents(spark, library, monkeypatch):
    rng = random.Random(1)
    texts = ["", None, LONG, "a <|endoftext|> b", *(" ".join(rng.choice(["the", "Größe", "token", "1234", "x"]) for _ in range(rng.randint(0, 900))) for _ in range(400))]
    df = docs(spark, *texts).repartition(9)
    encoded = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert check_packing(packing.pack(df, vocabulary()).collect(), encoded) < 0.03
    monkeypatch.setattr(packing, "FAN_IN", 2)  # several levels
    out = packing.pack(df, vocabulary())
    assert check_packing(out.collect(), encoded) < 0.03
    seqs = packing.sequences(out).collect()
    assert sum(r["n_tokens"] for r in seqs) == sum(len(x) + 1 for x in encoded.values())
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["padded_length"] in (1024, r["n_tokens"]) for r in seqs)


def test_packing_empty_table(spark):
    assert packing.pack(docs(spark, "x").limit(0), vocabulary()).collect() == []


def test_packing_repeated_ids(spark):
    rows = packing.pack(docs(spark, "a b", "a b").withColumn("doc_id", F.lit(None).cast("long")), vocabulary()).collect()
    assert sum(r["length"] for r in rows) == 6 and all(r["doc_id"] is None for r in rows)


# --- BPE


def strange(rng, n):
    letters = " \n\t\u00a0\u3000\x1c\x85\u200b'sdtmé²٣ßA1!<|endoftext|>🙂\u0301漢\r\x00\ufffd"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_codec_equals_the_library(library):
    texts = [*strange(random.Random(2), 3000), "", LONG, " " * 2000, "a" * 3000, "<|endoftext|>x <|endoftext|>", "it's I'm we'll", "a  b   c \n d"]
    c = bpe.Codec(vocabulary())
    for text, ids, e in zip(texts, c.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text[:60]
        assert c.decode(ids) == library.decode(e.ids, skip_special_tokens=False)
    assert [packing.token_ids(vocabulary(), t).tolist()[:-1] for t in texts[:500]] == [e.ids for e in library.encode_batch(texts[:500], add_special_tokens=False)]


def test_broken_bytes_decode_as_the_library_does(library):
    rng = random.Random(4)
    c = bpe.Codec(vocabulary())
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert c.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_encode_and_decode_documents(spark, library):
    texts = ["", None, LONG, "a b", "a b", "x\ny"]
    path = vocabulary()
    rows = sorted(bpe.decode_documents(bpe.encode_documents(docs(spark, *texts), path), path).collect(), key=lambda r: r["id"])
    for r, t in zip(rows, texts, strict=True):
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids and r["text"] == (t or "")
    once = sorted(bpe.round_trip(docs(spark, *texts), path).collect(), key=lambda r: r["id"])
    assert once == rows
    assert bpe.encode_documents(docs(spark, "x").limit(0), path).collect() == [] == bpe.round_trip(docs(spark, "x").limit(0), path).collect()
