"""Operator 3, WARC archives: written by Spark's text sink, read by boundary-chain verification.

Files are cut at every version line, inside payloads or not.  Each piece is a candidate record whose header tells the offset of its
successor.  Pointer jumping from the start of each file doubles the reached part of the chain in every round and keeps only reachable records, so
a version line inside a payload is part of that payload.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, bounded, discard, map_arrow, materialise

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
URN = "urn:vellum:"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits; records a file; date of records, a parameter so that files can be compared.
SMALL, RECORDS, DATE = 100, 2000, "2026-01-01T00:00:00Z"
#: What may not stand in a header line; in headers only a line feed ends a line (flag d).
CONTROL = r"[\x00-\x1F\x7F-\x9F\x{2028}\x{2029}]"


def urn(key: Column) -> Column:
    return F.concat(F.lit(URN), F.coalesce(F.concat(F.lit("id:"), F.url_encode(key.cast("string"))), F.lit("null")))


def key_of(name: Column, kind: str) -> Column:
    """The id in a record's name, null for a null id or a foreign name."""
    return F.url_decode(F.nullif(F.regexp_extract(name, f"^<?{URN}id:([^>]*)>?$", 1), F.lit(""))).cast(kind)


def one_line(url: Column) -> Column:
    """``url`` with control characters and line separators as percent escapes, so that it stays within its header line."""
    escaped = F.array_join(F.transform(F.split(url, ""), lambda x: F.when(x.rlike(CONTROL), F.url_encode(x)).otherwise(x)), "")
    return F.when(url.rlike(CONTROL), escaped).otherwise(url)


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """Write a record for each row: a response, or a revisit where a row with a smaller id has the same payload of at least 100 bytes.

    Null payloads are empty, null URLs name the record itself, control characters and line separators in URLs are percent escapes.  Null ids come
    last; rows that share the smallest id are all responses.  Files are gzip streams of at most 2000 records.  Payloads are not shuffled while the
    table of repeated payloads is within the broadcast bound, and those repeated very often never.  Other columns are not read, whatever their
    names; an empty table gives a folder without records.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # a null key is no repeat: short payloads are not looked up
    rows = rows.withColumn("again", F.when(F.octet_length("payload") >= SMALL, F.col("digest")))
    firsts = materialise(rows.where("again is not null").groupBy("again").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats")
    joined = attach(rows, firsts, ["again"], "left", weight="n")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    uri = F.coalesce(one_line(F.col("url")), urn(F.col("id")))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), urn(F.col("id")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), urn(F.col("first")), F.lit(">"))), line("X-Payload-Length", size))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    # the sink writes the bytes of a string as they are, and the separator is the end of a record
    record = F.concat(head.cast("binary"), block).cast("string")
    joined.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    discard(firsts)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, f, block, idx, local, value): pieces between version lines, numbered within what one task reads of a file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    src = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, idx, local = None, 0, 0
        for b in batches:
            places: list[tuple[int, int]] = []
            for file, block, value in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value"), strict=True):
                if (file, block) != here:
                    here, idx, local = (file, block), 0, 0
                places.append((idx, local))
                idx, local = idx + 1, local + len(value.as_buffer()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array([x for x, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64()), b.column("value")], ["file", "block", "idx", "local", "value"])

    return map_arrow(src, run, "file string, block long, idx long, local long, value binary").withColumn("f", F.xxhash64("file"))


def candidates(pieces: DataFrame) -> DataFrame:
    """(f, block, idx, at, end, next): where the piece's version line is, where the piece ends, and where its header says that the next record is."""
    text = F.col("value").cast("string")
    head = F.substring_index(text, END, 1)
    has = F.octet_length(head) < F.octet_length("value")
    length = F.when(has, F.regexp_extract(head, r"(?dim)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1))
    one = pieces.select("f", "block", "idx", "local", F.octet_length("value").cast("long").alias("size"), F.octet_length(head).cast("long").alias("head"), F.nullif(length, F.lit("")).cast("long").alias("length"))
    one = materialise(one, "pieces")
    before = Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = one.groupBy("f", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes")).select("f", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    start = F.col("base") + F.col("local")
    placed = one.join(bases, ["f", "block"]).where((F.col("block") > 0) | (F.col("idx") > 0))
    out = placed.select("f", "block", "idx", (start - len(MAGIC)).alias("at"), (start + F.col("size")).alias("end"), (start + F.col("head") + len(END) + F.col("length") + len(END)).alias("next"))
    done = materialise(out, "candidates")
    discard(one)
    return done


def reachable(found: DataFrame) -> DataFrame:
    """(f, at) of candidates on the chain from each file's start, by pointer jumping: rounds grow with the logarithm of the longest chain."""
    jump = materialise(found.where("next is not null").select("f", "at", F.col("next").alias("to")), "jump")
    reach = materialise(found.where("at = 0").select("f", "at"), "reach")
    while not jump.isEmpty():
        hop = reach.join(jump, ["f", "at"]).select("f", F.col("to").alias("at"))
        more = materialise(reach.unionByName(hop).distinct(), "reach")
        ahead = jump.select("f", F.col("at").alias("to"), F.col("to").alias("beyond"))
        twice = materialise(jump.join(ahead, ["f", "to"]).select("f", "at", F.col("beyond").alias("to")), "jump")
        discard(jump, reach)
        jump, reach = twice, more
    return reach


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: file, record_type, record_id, date, target_uri, refers_to, payload_digest, payload_length (as named), content_type,
    content, payload (content without its HTTP header) and truncated.

    Reads gzip or plain archives through Spark's text source, so plain ones are split.  What precedes the first version line, pieces that no record
    reaches, and files that don't start with a version line give no rows; an empty folder gives none either.  Repeated records are rows of their own;
    a header field that is missing or empty is null.
    """
    pieces = segments(spark, path)
    found = candidates(pieces)
    if not found.where("block > 0").isEmpty():  # another scan might split a plain file elsewhere: keep this one
        discard(found)
        pieces = materialise(pieces, "archive")
        found = candidates(pieces)
    chain = reachable(found)
    marked = materialise(found.join(chain.withColumn("linked", F.lit(True)), ["f", "at"], "left"), "marked")
    # the last linked record before a piece: in its own split, else that of the splits before, so that a large file is no single task
    here = F.last(F.when(F.col("linked"), F.col("at")), ignorenulls=True).over(Window.partitionBy("f", "block").orderBy("at"))
    ends = marked.groupBy("f", "block").agg(F.max(F.when(F.col("linked"), F.col("at"))).alias("end_at"))
    carried = ends.select("f", "block", F.max("end_at").over(Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    odd = marked.withColumn("here", here).join(carried, ["f", "block"]).withColumn("owner", F.coalesce("here", "carried")).where("linked is null or next is null or next <> end").select(F.col("f").alias("xf"), F.col("block").alias("xb"), F.col("idx").alias("xi"), "at", "owner")
    odd = materialise(odd, "odd")
    discard(chain, marked)
    rest = pieces.where("block > 0 or idx > 0").join(bounded(odd), (F.col("f") == F.col("xf")) & (F.col("block") == F.col("xb")) & (F.col("idx") == F.col("xi")), "left")
    plain = rest.where("xi is null").select("file", "value")
    parts = rest.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("v")))).alias("p"))
    whole = parts.select("file", F.array_join(F.transform("p", lambda x: x["v"]), MAGIC).cast("binary").alias("value"))
    return parsed(plain.unionByName(whole))


def parsed(records: DataFrame) -> DataFrame:
    head = F.substring_index(F.col("value").cast("string"), END, 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract("head", rf"(?dim)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    one = records.select("file", "value", head.alias("head")).withColumn("length", field("Content-Length").try_cast("long"))
    start = F.octet_length("head") + len(END)
    content = F.substring(F.col("value"), start + 1, F.least(F.coalesce(F.col("length"), F.lit(0)), F.lit(2**31 - 1)).cast("int"))
    two = one.select(
        "file",
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Date").alias("date"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("payload_digest"),
        field("X-Payload-Length").try_cast("long").alias("payload_length"),
        field("Content-Type").alias("content_type"),
        content.alias("content"),
        "length",
    )
    http = F.substring_index(F.col("content").cast("string"), END, 1)
    payload = F.when(F.col("content_type").startswith("application/http"), F.substring(F.col("content"), F.octet_length(http) + len(END) + 1, F.octet_length("content"))).otherwise(F.col("content"))
    return two.withColumn("payload", payload).withColumn("truncated", F.coalesce(F.octet_length("content") < F.col("length"), F.lit(True))).drop("length")
