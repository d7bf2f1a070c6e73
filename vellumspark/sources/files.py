"""A folder of files as canonical texts: every format its own branch, errors in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import body_markdown, decode_entities, html_title
from ..functions.html import collapse_blank_lines
from ..functions.text import detect_format, in_batch, is_blank
from ..operators.grid import csv_markdown
from ..operators.plaintext import txt_to_markdown
from ..shipping import ship
from .delimited import csv_rows
from .workbook import workbook, workbook_markdown

#: Errors of files that cannot be converted.
EMPTY = {"csv": "CSV file is empty", "html": "HTML file is empty", "txt": "text file is empty"}
XLS = "XLS (legacy Excel) format is not supported; save as XLSX"


def scan(spark: SparkSession, folder: str, batch: bool = True) -> DataFrame:
    """(path, modified, length, content, format) of all files below a folder, those of a batch only if ``batch``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = raw.select("path", F.col("modificationTime").alias("modified"), "length", "content")
    kept = files.where(in_batch(F.col("path"))) if batch else files
    return kept.withColumn("format", detect_format(F.col("path")))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def canonical(files: DataFrame) -> DataFrame:
    """``files`` with ``md`` (null where there is an error) and ``error``; contents stay out of the result.

    Each format is a branch of its own, so that only its files pay for its reader.
    """
    ship(files.sparkSession)
    text = F.col("content").cast("string")
    keep = [c for c in files.columns if c != "content"]
    of = lambda *names: files.where(F.col("format").isin(*names))
    plain = of("markdown").select(*keep, text.alias("md"), F.lit(None).cast("string").alias("error"))
    txt = of("txt").select(*keep, txt_to_markdown(text, F.col("path")).alias("md")).withColumn("error", F.when(F.col("md").isNull(), EMPTY["txt"]))
    pages = of("html").select(*keep, text.alias("t")).withColumn("body", body_markdown(F.col("t"), lambda s: s))
    body = collapse_blank_lines(decode_entities(F.col("body")))
    html = pages.select(*keep, F.when(~is_blank(F.col("t")), F.concat(F.lit("---\ntitle: "), html_title(F.col("t"), F.col("path")), F.lit("\n---\n\n"), body)).alias("md")).withColumn("error", F.when(F.col("md").isNull(), EMPTY["html"]))
    csv = of("csv").select(*keep, F.when(~is_blank(text), text).alias("t")).withColumn("rows", csv_rows(F.col("t")))
    csv = csv.select(*keep, csv_markdown(F.col("rows"), F.col("path")).alias("md")).withColumn("error", F.when(F.col("md").isNull(), EMPTY["csv"]))
    books = of("xlsx").select(*keep, workbook(F.col("content")).alias("book"))
    xlsx = books.select(*keep, workbook_markdown(F.col("book"), F.col("path"), folder_of(F.col("path"))).alias("md"), F.col("book.error").alias("error"))
    xls = of("xls").select(*keep, F.lit(None).cast("string").alias("md"), F.lit(XLS).alias("error"))
    out = plain
    for part in (txt, html, csv, xlsx, xls):
        out = out.unionByName(part)
    return out


def media(files: DataFrame) -> DataFrame:
    """(path, name, file, content) of pictures in spreadsheets."""
    ship(files.sparkSession)
    books = files.where(F.col("format") == "xlsx").select("path", workbook(F.col("content")).alias("book"))
    return books.select("path", F.explode("book.media").alias("m")).select("path", "m.*")


def summary(results: DataFrame) -> DataFrame:
    """One row: files and successes."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"))
