"""Operator 9, BPE encoding and decoding in batched numpy merge rounds.

Words that a worker has not met are laid out as symbols in one flat array.  Each round looks all neighbouring pairs up in the
sorted pair keys by binary search, finds the lowest rank of every word and merges all places of that pair at once, until no word has a pair left.
Met words are kept in a bounded cache; a text's ids are the joined bytes of its words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow


#: Words that a worker remembers, and characters of text encoded at a time.
CACHE_WORDS = 400_000
BATCH_CHARS = 500_000
#: Rows of a batch that a worker gives back.
EMIT_ROWS = 500
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A space that does not start a word of its own: the text is then cut by the slower rule.
ODD_SPACE = re.compile(r" (?:\s|\Z)")
WORD_START = re.compile(r"(?= \S)")
NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """Byte-level BPE as in a ``tokenizers`` JSON file without normaliser."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level BPE without normaliser or prefix space")
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.after: dict[str, bytes] = {}  # words behind a space, kept without it
        self.start: dict[str, bytes] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs, by binary search; NONE for those that never merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        last = np.zeros(sym.size, bool)  # of its word
        last[np.cumsum(lengths)[lengths > 0] - 1] = True
        rank, into = np.full(sym.size, NONE, np.int32), np.zeros(sym.size, np.int64)
        fresh = np.flatnonzero(~last)
        rank[fresh], into[fresh] = self.pairs(sym[fresh], sym[fresh + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while sym.size:
            begins = np.flatnonzero(np.append(True, last[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, sym.size)))
            over = least == NONE
            if over.any():
                done.append((word[over], sym[over]))
                stay = ~over
                sym, word, last, rank, into, least = sym[stay], word[stay], last[stay], rank[stay], into[stay], least[stay]
                if not sym.size:
                    break
            hit = np.flatnonzero(rank == least)
            # of overlapping places (aaa) every other one, from the left
            new = np.append(True, np.diff(hit) != 1)
            run = np.maximum.accumulate(np.where(new, np.arange(hit.size), 0))
            hit = hit[(np.arange(hit.size) - run) % 2 == 0]
            sym[hit] = into[hit]
            last[hit] = last[hit + 1]
            keep = np.ones(sym.size, bool)
            keep[hit + 1] = False
            sym, word, last, rank, into = sym[keep], word[keep], last[keep], rank[keep], into[keep]
            # only the pairs at a merged symbol, on either side, are looked up again
            at = hit - np.arange(hit.size)
            rank[at[last[at]]] = NONE
            before = at[at > 0] - 1
            fresh = np.concatenate([at[~last[at]], before[~last[before]]])
            rank[fresh], into[fresh] = self.pairs(sym[fresh], sym[fresh + 1])
        if not done:
            return [b""] * len(words)
        words_done, syms = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(words_done, kind="stable")
        ends = np.cumsum(np.bincount(words_done, minlength=len(words))) * 4
        flat = syms[order].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, texts: Iterable[str], known: dict[str, bytes], lead: str) -> None:
        """Add the ids of texts that are cut at word starts, each behind ``lead``."""
        new = [t for t in texts if t not in known]
        if not new:
            return
        pieces: list[bytes] = []
        counts = []
        for t in new:
            if t.isalpha():
                pieces.append((lead + t).encode("utf-8", "replace"))
                counts.append(1)
            else:
                found = PIECES.findall(lead + t)
                pieces += [x.encode("utf-8", "replace") for x in found]
                counts.append(len(found))
        ids = self.merge(pieces)
        at = 0
        for t, n in zip(new, counts, strict=True):
            known[t] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the special tokens' strings become their ids."""
        group: list[list[tuple[list[str], int] | bytes]] = []
        size = 0
        for text in texts:
            parts: list[tuple[list[str], int] | bytes] = []
            for seg in self.cut.split(text) if self.cut else [text]:
                if seg in self.special:
                    parts.append(self.special[seg].to_bytes(4, "little"))
                elif seg:
                    parts.append((WORD_START.split(seg), 0) if ODD_SPACE.search(seg) else (seg.split(" "), 1))
            group.append(parts)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._join(group)
                group, size = [], 0
        yield from self._join(group)

    def _join(self, group: list) -> Iterator[bytes]:
        if len(self.after) + len(self.start) > CACHE_WORDS:
            self.after.clear()
            self.start.clear()
        after: set[str] = set()
        start: set[str] = set()
        for parts in group:
            for p in parts:
                if isinstance(p, tuple):
                    words, plain = p
                    if plain:
                        start.add(words[0])
                        after.update(words[1:])
                    else:
                        start.update(words)
        self.learn(after, self.after, " ")
        self.learn(start, self.start, "")
        for parts in group:
            out = []
            for p in parts:
                if isinstance(p, bytes):
                    out.append(p)
                elif p[1]:
                    out.append(self.start[p[0][0]])
                    out.extend(map(self.after.__getitem__, p[0][1:]))
                else:
                    out.extend(map(self.start.__getitem__, p[0]))
            yield b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids as little-endian unsigned 32-bit integers, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit), one row for each row of ``df``; null text is empty and has no ids.

    ``path`` is read by the workers: it names a file that every machine has.  Other columns are not read.  Row by row, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = list(codec(path).encode([t or "" for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids binary")


def decode_documents(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) from ids as :func:`encode_documents` gives them; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [codec(path).decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "text"])

    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids binary, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): :func:`encode_documents` and :func:`decode_documents` in one worker, a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, EMIT_ROWS):
                part = b.slice(at, EMIT_ROWS)
                ids = list(c.encode([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], ["id", "ids", "text"])

    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids binary, text string")
