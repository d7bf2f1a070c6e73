"""Operator 2, harmonic packing.

A document is cut into whole sequences and a rest; a rest that would leave much of its reciprocal class empty is cut once more at the next class.
A piece of at most capacity/k tokens belongs to class k, and k pieces of class k make a sequence: every worker fills its own
sequences without asking the others.  What is left of each class and worker, a bounded number of pieces, is packed in the same way by groups of workers,
level by level, and at the last level first-fit by decreasing length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import grouped, map_arrow, materialise

CAPACITY = 1024
#: Tokens of its class's share that a rest may leave empty before it is cut once more.
SLACK = 8
#: Workers whose left pieces are packed together at one level.
FAN_IN = 64
#: Pieces that a worker gathers before it gives them back.
EMIT_PIECES = 1024
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id {id}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """(encode, special ids): the vocabulary of a ``tokenizers`` JSON file run by tiktoken, which gives the same ids faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), frozenset(special)


def token_ids(path: str, text: str) -> np.ndarray:
    encoding, special = tokenizer(path)
    try:
        ids = encoding.encode_to_numpy(text, allowed_special=special)
    except BaseException as e:  # the library gives up on very long runs of blanks by a panic, which is no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        from .bpe import codec

        ids = np.frombuffer(next(codec(path).encode([text])), "<u4")
    return np.append(ids.astype("<u4"), np.uint32(0))


def class_of(length: int, capacity: int) -> int:
    """The pieces of such a length that a sequence of its class takes: all counts to 64, powers of two beyond."""
    k = capacity // length
    return k if k <= 64 else 1 << (k.bit_length() - 1)


def cuts(tokens: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest:
        k = class_of(rest, capacity)
        share = capacity // k
        if share - rest <= slack or k >= 64:
            out.append(rest)
            break
        part = capacity // (k + 1)
        out.append(part)
        rest -= part
    return out


class Filler:
    """Fills sequences class by class; pieces are tuples whose second item is their length."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple] | None:
        """The pieces of a sequence that this one has filled."""
        k = class_of(piece[1], self.capacity)
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.open.pop(k) if len(held) == k else None

    def left(self) -> list[tuple]:
        return [p for k in sorted(self.open) for p in self.open[k]]


def first_fit(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Sequences by first fit, longest piece first; the number of pieces is bounded by the classes."""
    bins: list[list[tuple]] = []
    room = np.zeros(0, np.int64)
    for p in sorted(pieces, key=lambda p: (-p[1], str(p[0]))):
        fits = np.flatnonzero(room >= p[1])
        if fits.size:
            bins[fits[0]].append(p)
            room[fits[0]] -= p[1]
        else:
            bins.append([p])
            room = np.append(room, capacity - p[1])
    return bins


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """One row a piece: doc_id, start and length (in the document's tokens), ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens,
    sequence_id and offset in the sequence, which has no gap from 0 on.

    Null text is empty and packs as its one end token; repeated rows and ids are packed each for itself; other columns are not read; an
    empty table gives an empty result.  Sequence ids are unique, not dense.  Texts are read once and token ids written once to the shared folder.
    """
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(id=kind) + ", part long"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, number, part = Filler(capacity), 0, 0
        rows: list[tuple] = []
        id_type = None
        for b in batches:
            if not b.num_rows:
                continue
            part, id_type = b.column("part")[0].as_py(), b.column("doc_id").type
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids = token_ids(path, text.as_py() or "")
                at = 0
                for n in cuts(len(ids), capacity, slack):
                    data = ids[at : at + n].tobytes()
                    full = filler.add((doc.as_py(), n, at, data, len(ids)))
                    at += n
                    if full:
                        rows += placed(full, (part << 34) + number)
                        number += 1
                if len(rows) >= EMIT_PIECES:
                    yield batch(rows, id_type, part)
                    rows = []
        rows += [(p, None, None) for p in filler.left()]
        if rows:
            yield batch(rows, id_type, part)

    first = materialise(map_arrow(src, local, schema), "pieces")
    done = [first.where("sequence_id is not null").drop("part")]
    left, level = first.where("sequence_id is null"), 1
    groups = left.agg(F.max("part")).first()[0]
    while groups is not None:
        last = groups < FAN_IN
        merged = materialise(grouped(left.withColumn("part", F.floor(F.col("part") / FAN_IN)), ["part"], regroup(level, last, capacity), schema), f"left{level}")
        done.append(merged.where("sequence_id is not null").drop("part"))
        if last:
            break
        left, level = merged.where("sequence_id is null"), level + 1
        groups = left.agg(F.max("part")).first()[0]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def placed(pieces: list[tuple], sequence: int) -> list[tuple]:
    at, out = 0, []
    for p in pieces:
        out.append((p, sequence, at))
        at += p[1]
    return out


def batch(rows: list[tuple], id_type: pa.DataType, part: int) -> pa.RecordBatch:
    longs = lambda xs: pa.array(list(xs), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p, _, _ in rows], id_type),
            longs(p[2] for p, _, _ in rows),
            longs(p[1] for p, _, _ in rows),
            pa.array([p[3] for p, _, _ in rows], pa.binary()),
            longs(zlib.crc32(p[3]) for p, _, _ in rows),
            longs(p[4] for p, _, _ in rows),
            longs(s for _, s, _ in rows),
            longs(o for _, _, o in rows),
            longs(part for _ in rows),
        ],
        ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"],
    )


def regroup(level: int, last: bool, capacity: int):
    """Packs what one group of workers has left; at the last level all of it."""

    def compute(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_pylist() for c in ("doc_id", "length", "start", "ids", "doc_tokens")]
        pieces = sorted(zip(*cols, strict=True), key=lambda p: (str(p[0]), p[2]))
        part = table.column("part")[0].as_py()
        filler, rows, number = Filler(capacity), [], 0
        head = (level << 58) + (part << 34)
        for p in pieces:
            if full := filler.add(p):
                rows += placed(full, head + number)
                number += 1
        if last:
            for bin_ in first_fit(filler.left(), capacity):
                rows += placed(bin_, head + number)
                number += 1
        else:
            rows += [(p, None, None) for p in filler.left()]
        return batch(rows, table.column("doc_id").type, part)

    return compute


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids binary, n_tokens, padded_length): the sequences themselves; padded to the capacity, except at a power of two."""
    put = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(put.alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return rows.select("sequence_id", joined.alias("ids"), "n_tokens", F.when(power, F.col("n_tokens")).otherwise(F.lit(capacity)).alias("padded_length"))


