"""Operator 5, personal data: patterns find seeds, contexts of the seeds find more.

Regular expressions give the base spans (e-mail, IP address, card, phone).  Around every base span, and around every other token or run of tokens that
could be an identifier, the neighbouring words are lexical patterns.  Spark holds the graph of patterns and values and scores both in turns: a
pattern is as trustworthy for a kind as the values that it meets, and a value as probable as its trusted patterns make it.  Values that reach the
score, all of their places, are added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded, discard, fresh, map_arrow, materialise

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
#: Groups of digits joined by blanks, dots, dashes or brackets; an address in words.
RUN = re.compile(r"[+(\[]{0,2}(?<![0-9])[0-9]++(?:[\x20\t\xa0.()\[\]/-]{1,3}+[0-9]++)++")
DOT = re.compile(r"\s[(\[]?dot[)\]]?\s", re.IGNORECASE)
WORDED = re.compile(r"(?<![\w.+-])[\w.+-]++\s{1,2}[(\[]?at[)\]]?\s{1,2}[\w-]++(?:\s{1,2}[(\[]?dot[)\]]?\s{1,2}[\w-]++)++", re.IGNORECASE)
LETTERS, DIGITS = re.compile(r"[^\W\d_]++"), re.compile(r"\d++")
EDGES = ".,;:!?\"'()[]{}<>=#*&%$|`"
#: Length from which values and words go by their hash, and how many digits make an identifier.
HASHED, FEWEST_DIGITS = 65, 4
#: What stands for a value in the context of another one, by kind; the last ones for unknown kinds.
PLACES = ("[email]", "[ip]", "[card]", "[phone]", "[?]", "[?]")
#: Context of an occurrence: words before it from the nearest on, words after it, and the shape of its value.
WORDS = ("before", "before2", "after", "after2", "shape")
#: A pattern needs so many distinct seeds or discovered values of a kind, and such a share of its values; a value such a score.  Turns at least.
MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE, ROUNDS = 3, 0.8, 0.9, 3

OCC = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), *((w, pa.string()) for w in WORDS)]))
OCC_DDL = "array<struct<kind:int,start:bigint,end:bigint,value:string," + ",".join(f"{w}:string" for w in WORDS) + ">>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, not overlapping within a kind.  In time linear in the text."""
    if not HINT.search(text):
        return []
    out: list[tuple[int, int, int]] = []
    end = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        while at > end and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            out.append((0, at, m.end()))
            end = m.end()
    out += [(1, *m.span()) for m in IP.finditer(text) if all(small(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


class Contexts:
    """The words around the occurrences (kind, start, end) of a text.

    Blanks and marks between an occurrence and a word don't count; a neighbouring occurrence stands for a word.  No walk goes past a neighbour, so that
    all of them together take linear time.
    """

    def __init__(self, text: str, occurrences: list[tuple[int, int, int]]) -> None:
        self.text = text
        by_end, by_start = sorted(occurrences, key=lambda o: (o[2], o[1], o[0])), sorted(occurrences, key=lambda o: (o[1], o[2], o[0]))
        self.ends, self.starts = [o[2] for o in by_end], [o[1] for o in by_start]
        self.by_end, self.by_start = by_end, by_start
        self.run_starts, self.run_ends = ({o[i] for o in occurrences if o[0] == -1} for i in (1, 2))

    def before(self, at: int) -> tuple[str, int]:
        """The word before a place, and where it starts."""
        i = bisect_right(self.ends, at) - 1
        stop, text = self.ends[i] if i >= 0 else 0, self.text
        while at > stop and (text[at - 1].isspace() or text[at - 1] in EDGES):
            at -= 1
        if at == stop:
            return (PLACES[self.by_end[i][0]], self.by_end[i][1]) if i >= 0 else ("", 0)
        end = at
        while at > stop and not text[at - 1].isspace():
            at -= 1
        return value_of(text[at:end].strip(EDGES)), at

    def after(self, at: int) -> tuple[str, int]:
        """The word behind a place, and where it ends."""
        i, text = bisect_left(self.starts, at), self.text
        stop = self.starts[i] if i < len(self.starts) else len(text)
        while at < stop and (text[at].isspace() or text[at] in EDGES):
            at += 1
        if at == stop:
            return (PLACES[self.by_start[i][0]], self.by_start[i][2]) if i < len(self.starts) else ("", stop)
        start = at
        while at < stop and not text[at].isspace():
            at += 1
        return value_of(text[start:at].strip(EDGES)), at

    def around(self, kind: int, start: int, end: int) -> tuple[str, ...]:
        """The context; a token at a run's edge has none on that side, where it is the run's."""
        before, at = ("", 0) if kind == -2 and start in self.run_starts else self.before(start)
        after, to = ("", 0) if kind == -2 and end in self.run_ends else self.after(end)
        return before, self.before(at)[0] if before else "", after, self.after(to)[0] if after else "", shape_of(self.text[start:end])


def shape_of(value: str) -> str:
    """Runs of digits as 0, of letters as a, other characters as they are; no shape for what holds neither, and hashed where long."""
    return value_of(LETTERS.sub("a", DIGITS.sub("0", value)))


def runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of digit groups, without groups that are part of a word."""
    for m in RUN.finditer(text, start, end):
        a, b = m.span()
        while a < b and not text[a].isdigit() and a and text[a - 1].isalnum():
            a += 1
        if a and (text[a - 1].isalnum() or text[a - 1] in "@_"):
            while a < b and text[a].isdigit():
                a += 1
            while a < b and not text[a].isdigit():
                a += 1
        if b < len(text) and (text[b].isalpha() or text[b] in "@_"):
            while b > a and text[b - 1].isdigit():
                b -= 1
            while b > a and not text[b - 1].isdigit():
                b -= 1
        for opening, closing in ("()", "[]"):
            while a < b and text[a] == opening and text.find(closing, a, b) < 0:
                a += 1
        yield a, b


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Phone and card numbers that stand side by side in a run of digit groups, so that the run as a whole is neither: the longest from each place on."""
    groups = [m.span() for m in DIGITS.finditer(text, start, end)]
    out, i = [], 0
    while i < len(groups):
        a = groups[i][0]
        plus = a > start and text[a - 1] == "+"
        best, digits = None, ""
        for j in range(i, len(groups)):
            if j > i and not plus and text[groups[j - 1][1] : groups[j][0]] not in (" ", "-"):
                break
            digits += text[slice(*groups[j])]
            if len(digits) > 19 or not digits.isascii():
                break
            if 9 <= len(digits) <= 15 if plus else 13 <= len(digits) and luhn(digits):
                best = j
        if best is None:
            i += 1
        else:
            out.append((a - plus, groups[best][1]))
            i = best + 1
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of other tokens and runs of tokens that could be identifiers, without the marks around them: kind is -2 for tokens within
    a run, else -1.  Runs are cut where numbers stand side by side."""
    hint = HINT.search(text)
    worded = [m.span() for m in WORDED.finditer(text)] if DOT.search(text) else []
    if not hint and not worded:
        return []
    taken = sorted((a, b) for _, a, b in spans)
    wide, at = [], 0
    for start, end in [*taken, (len(text), len(text))]:
        if at < start:
            for a, b in runs(text, at, start):
                if sum("0" <= c <= "9" for c in text[a:b]) >= FEWEST_DIGITS:
                    wide += parts(text, a, b) or [(a, b)]
        at = max(at, end)
    k = 0
    for a, b in worded:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            wide.append((a, b))
    wide.sort()
    out, at, k, w = [(-1, a, b) for a, b in wide], 0, 0, 0
    while m := HINT.search(text, at):
        a = b = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        at = b
        while a < b and text[a] in EDGES:
            a += 1
        while b > a and text[b - 1] in EDGES:
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        while w < len(wide) and wide[w][1] < b:
            w += 1
        within = w < len(wide) and wide[w][0] <= a
        if within and wide[w] == (a, b):
            continue
        token = text[a:b]
        if a < b and ("@" in token or sum("0" <= c <= "9" for c in token) >= FEWEST_DIGITS):
            out.append((-2 if within else -1, a, b))
    return out


def value_of(token: str) -> str:
    """What stands for a token: itself, or its hash if it is long."""
    token = token.lower()
    return token if len(token) < HASHED else "#" + hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, spans array<struct<kind,start,end>>, occurrences with contexts): key tells texts of one id apart."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            occ = []
            for t in b.column("text").to_pylist():
                spans = base_spans(t)
                all_ = [*spans, *candidates(t, spans)]
                near = Contexts(t, all_)
                occ.append([{"kind": kind, "start": a, "end": e, "value": value_of(t[a:e]), **dict(zip(WORDS, near.around(kind, a, e), strict=True))} for kind, a, e in all_])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(occ, OCC)], ["doc_id", "key", "occ"])

    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key long, occ {OCC_DDL}")


#: Patterns by name: the parts of a context that they hold.  A shape alone is none, as it says no more of a value than what it looks like.
PATTERNS = {
    "b": ("before",),
    "bb": ("before2", "before"),
    "ba": ("before", "after"),
    "a": ("after",),
    "aa": ("after", "after2"),
    "sb": ("shape", "before"),
    "sa": ("shape", "after"),
}


def bootstrap(occ: DataFrame) -> DataFrame:
    """(value, kind, score) of values that trusted patterns discover, and of known values that are no seeds in other places (score 1).  ``occ``: (value,
    kind, *WORDS), kind below 0 where unknown.

    Patterns and values meet as distinct edges; one word that comes before a third of all values is an edge for each value, pre-aggregated before it is
    dealt out, and is never gathered in one row.  A pattern's confidence in a kind is the share of its values that have it, discovered ones by their score;
    it is trusted from MIN_SEEDS such values and MIN_CONFIDENCE on.  A value's score is the probability that not all of its trusted patterns err.
    Turns go on until neither values nor trusted patterns are added.  A pattern needs all of its words: null and empty ones, and columns that ``occ`` lacks,
    make none.
    """
    named = []
    for name, words in PATTERNS.items():
        if set(words) <= set(occ.columns):
            filled = [F.coalesce(F.col(w), F.lit("")) != "" for w in words]
            named.append(F.when(reduce(Column.__and__, filled), F.concat_ws(" ", F.lit(name), *words)))
    pattern = F.explode(F.filter(F.array(*named), lambda x: x.isNotNull()))
    met = materialise(occ.select(pattern.alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "met")
    # a value that is a seed anywhere is a seed of that kind, under every pattern
    kinds = materialise(occ.groupBy("value").agg(F.max("kind").alias("known"), F.min("kind").alias("least")), "kinds")
    edges = materialise(attach(met, kinds, ["value"]).select("pattern", "value", F.col("known").alias("kind")), "edges")
    again = kinds.where("known >= 0 and least < 0").select("value", F.col("known").alias("kind"), F.lit(1.0).alias("score"))
    discard(met)
    unknown = edges.where("kind < 0")
    # a pattern of fewer values can never be trusted; seeds never change: their part of a pattern is summed once
    seeds = materialise(edges.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(f"s{k}") for k in range(4))).where(F.col("n") >= MIN_SEEDS), "seeds")
    scores: DataFrame | None = None
    turn, reached = 0, (-1, -1)
    while True:
        known = [f"s{k}" for k in range(4)]
        both = seeds.select("pattern", "n", *known, *(F.lit(0.0).alias(f"g{k}") for k in range(4)), *(F.lit(0).cast("long").alias(f"d{k}") for k in range(4)))
        if scores is not None:
            of = lambda k: F.col("best") == k
            gained = attach(unknown, scores, ["value"]).groupBy("pattern").agg(
                *(F.sum(F.when(of(k), F.col("score")).otherwise(0.0)).alias(f"g{k}") for k in range(4)), *(F.count_if(of(k) & (F.col("score") >= MIN_SCORE)).alias(f"d{k}") for k in range(4))
            )
            new = [f"{x}{k}" for x in "gd" for k in range(4)]
            both = seeds.join(gained, "pattern", "left").select("pattern", "n", *known, *(F.coalesce(c, F.lit(0)).alias(c) for c in new))
        trust = both.select("pattern", *(F.when(F.col(f"s{k}") + F.col(f"d{k}") >= MIN_SEEDS, F.least(F.lit(1.0), (F.col(f"s{k}") + F.col(f"g{k}")) / F.col("n"))).otherwise(0.0).alias(f"c{k}") for k in range(4)))
        trusted = materialise(trust.where(" or ".join(f"c{k} >= {MIN_CONFIDENCE}" for k in range(4))), "trusted")
        logs = [F.sum(F.when(F.col(f"c{k}") >= MIN_CONFIDENCE, F.log(F.greatest(1 - F.col(f"c{k}"), F.lit(0.05)))).otherwise(0.0)).alias(f"l{k}") for k in range(4)]
        by_value = attach(unknown, trusted, ["pattern"]).groupBy("value").agg(*logs)
        top = F.least(*(F.col(f"l{k}") for k in range(4)))
        best = F.coalesce(*(F.when(F.col(f"l{k}") == top, F.lit(k)) for k in range(4)))
        found = materialise(by_value.select("value", best.alias("best"), (1 - F.exp(top)).alias("score")), "scores")
        now = (found.where(F.col("score") >= MIN_SCORE).count(), trusted.count())
        discard(scores, trusted)
        scores, turn = found, turn + 1
        # a pattern trusted in this turn may bring its values over the score in the next
        if turn >= ROUNDS and now[0] <= reached[0] and now[1] <= reached[1]:
            break
        reached = now
    discard(edges, seeds)
    return scores.where(F.col("score") >= MIN_SCORE).select("value", F.col("best").alias("kind"), "score").unionByName(again)


def scanned_and_found(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The written scan, and (uid, found array<struct<kind,start,end>>) of rows with discovered spans."""
    table = materialise(scan(df, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pii")
    occ = table.select("uid", F.explode("occ").alias("o")).select("uid", "o.*")
    values = materialise(bootstrap(occ).select("value", "kind"), "values")
    places = attach(occ.where("kind < 0").select("uid", "value", "start", "end"), values, ["value"])
    found = places.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    return table, materialise(found, "found")


def span_text(spans):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, key (hash of the text), base and spans (arrays of struct<kind,start,end>, by kind, then start).

    ``base`` has what the regular expressions find, ``spans`` also what the contexts discover; starts and ends count code points.  Null text is
    empty, repeated rows are searched alike (a value counts once however often it is repeated), other columns are not read, an empty table gives
    an empty result.  Candidates are tokens with '@' or four digits, runs of digit groups joined by blanks, dots, dashes, slashes or brackets, and addresses
    in words ("jane at example dot com"); identifiers without any of these are not found.  Long ones are known by 128-bit hashes.
    """
    table, found = scanned_and_found(df, id_col, text_col)
    base = F.transform(F.filter("occ", lambda o: o["kind"] >= 0), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    joined = table.join(bounded(found), "uid", "left").select("doc_id", "key", base.alias("base"), "found")
    return joined.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("found", F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")))).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets, like [email]; overlapping spans become one, named by the first.

    All columns stay, whatever their names; null text stays null.  Texts without spans are passed on as they are; repeated rows are treated alike; an empty
    table gives an empty result.
    """
    other, key, list_, merged_col = fresh(df, "__id", "__key", "__spans", "__merged")
    spans = find_pii(df, id_col, text_col).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(other), F.col("key").alias(key)).agg(F.first("spans").alias(list_))
    spans = materialise(spans, "spans")
    text, m = F.col(f"`{text_col}`"), F.col(merged_col)
    joined = df.join(bounded(spans), F.col(f"`{id_col}`").eqNullSafe(F.col(other)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(key)), "left")
    # merge overlaps, then cut the text between them; all in the JVM
    zero = F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")
    by_start = F.array_sort(F.transform(list_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(acc, s):
        last = F.element_at(acc, -1)
        s2 = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        grown = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(s2)).when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s2)))

    merged = F.aggregate(by_start, zero, add)
    end_before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(m, i - 1)["end"])
    part = F.transform(m, lambda s, i: F.concat(F.substring(text, end_before(i).cast("int") + 1, (s["start"] - end_before(i)).cast("int")), F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]")))
    done = F.concat(F.array_join(part, ""), F.substring(text, F.element_at(m, -1)["end"].cast("int") + 1, F.length(text)))
    out = joined.withColumn(merged_col, F.when(F.col(list_).isNotNull(), merged))
    return out.select(*(F.col(f"`{c}`") if c != text_col else F.when(m.isNull(), text).otherwise(done).alias(c) for c in df.columns))
