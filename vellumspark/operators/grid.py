"""Grids of cells to canonical Markdown, row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.html import pad_row, pipe_row
from ..functions.text import is_blank, let, title_from_filename, trimmed
from .markdown import rest
from .plaintext import is_caps_heading

#: Bytes from which a lone first cell is a paragraph, and below which a lone word is a heading.
PARAGRAPH, WORD = 80, 60


def width_of(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def pipe_table(rows: Column, width: Column, trim: bool) -> Column:
    """Header, rule and data rows, then a line with the size."""
    cells = (lambda r: F.transform(pad_row(r, width), trimmed)) if trim else (lambda r: pad_row(r, width))
    line = lambda r: F.concat(pipe_row(cells(r)), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""), F.lit("\n"))
    size = F.concat(F.lit("\n*"), (F.size(rows) - 1).cast("string"), F.lit(" rows, "), width.cast("string"), F.lit(" columns*\n"))
    return F.concat(line(rows[0]), rule, F.array_join(F.transform(rest(rows, 2), line), ""), size)


def csv_markdown(rows: Column, path: Column) -> Column:
    """Canonical text of delimited records; null without records, which is an error."""
    head = F.concat(F.lit("---\ntitle: "), title_from_filename(path), F.lit("\nstyle: report\n---\n\n"))
    filled = let(width_of(rows), lambda w: F.when(w == 0, F.concat(head, F.lit("No data.\n"))).otherwise(F.concat(head, F.lit("## Data\n\n"), pipe_table(rows, w, True))))
    return F.when(F.size(rows) > 0, filled)


def count_filled(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: ~is_blank(c)))


def is_prose(row: Column) -> Column:
    """One filled cell, the first, of at least 80 bytes."""
    return (count_filled(row) == 1) & (F.octet_length(trimmed(row[0])) >= PARAGRAPH)


def sheet_kind(rows: Column) -> Column:
    """empty, text, mixed or table."""

    def judge(w: Column) -> Column:
        prose = F.size(F.filter(rows, is_prose))
        text = (w <= 2) & (prose > F.floor(F.size(rows) / 2).cast("int"))
        mixed = F.exists(rows, is_prose) & F.exists(rows, lambda r: count_filled(r) > 1)
        return F.when(w == 0, "empty").when(text, "text").when(mixed, "mixed").otherwise("table")

    return let(width_of(rows), judge)


def text_sheet(rows: Column) -> Column:
    heading = lambda t: ((F.octet_length(t) < WORD) & ~t.contains(" ")) | is_caps_heading(t)
    texts = F.filter(F.transform(rows, lambda r: trimmed(F.coalesce(F.get(r, 0), F.lit("")))), lambda t: t != "")
    return F.array_join(F.transform(texts, lambda t: F.concat(F.when(heading(t), "### ").otherwise(""), t, F.lit("\n\n"))), "")


def table_sheet(rows: Column, width: Column) -> Column:
    return F.concat(pipe_table(rows, width, False), F.lit("\n"))


def mixed_sheet(rows: Column, width: Column) -> Column:
    """Prose rows are paragraphs; from the first other filled row on to the next prose row is a table."""
    prose = lambda r: (count_filled(r) <= 1) & (F.octet_length(trimmed(F.coalesce(F.get(r, 0), F.lit("")))) >= PARAGRAPH)
    cuts = F.filter(F.transform(rows, lambda r, i: F.when(prose(r), i + 1)), lambda i: i.isNotNull())

    def build(at: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), at)

        def stretch(start: Column, k: Column) -> Column:
            part = F.slice(rows, start + 1, F.greatest(F.lit(0), F.coalesce(F.get(at, k), F.size(rows) + 1) - start - 1))
            begin = F.array_position(F.transform(part, lambda r: count_filled(r) > 0), True).cast("int")
            lead = F.when(start > 0, F.concat(trimmed(F.get(rows, start - 1)[0]), F.lit("\n\n"))).otherwise("")
            return F.concat(lead, let(begin, lambda b: F.when(b > 0, let(rest(part, b), lambda p: table_sheet(p, width))).otherwise("")))

        return F.array_join(F.transform(ends, stretch), "")

    return let(cuts, build)


def sheet_markdown(rows: Column) -> Column:
    kind = sheet_kind(rows)
    return let(width_of(rows), lambda w: let(kind, lambda k: F.when(k == "empty", "*Empty sheet*\n\n").when(k == "text", text_sheet(rows)).when(k == "mixed", mixed_sheet(rows, w)).otherwise(table_sheet(rows, w))))


def chart_table(series: Column) -> Column:
    """Category and one column a series; categories are those of the first series that has any, missing ones their number.

    ``series``: array<struct<name, categories array<string>, values array<string>>>.
    """
    longest = F.coalesce(F.array_max(F.transform(series, lambda s: F.greatest(F.size(s["categories"]), F.size(s["values"])))), F.lit(0))
    names = F.transform(series, lambda s: F.when(s["name"] == "", "Series").otherwise(s["name"]))
    categories = F.coalesce(F.try_element_at(F.filter(F.transform(series, lambda s: s["categories"]), lambda c: F.size(c) > 0), F.lit(1)), F.expr("cast(array() as array<string>)"))

    def build(n: Column) -> Column:
        row = lambda i: F.concat(pipe_row(F.concat(F.array(F.coalesce(F.get(categories, i), (i + 1).cast("string"))), F.transform(series, lambda s: F.coalesce(F.get(s["values"], i), F.lit(""))))), F.lit("\n"))
        head = F.concat(pipe_row(F.concat(F.array(F.lit("Category")), names)), F.lit("\n| --- |"), F.array_join(F.array_repeat(F.lit(" --- |"), F.size(series)), ""), F.lit("\n"))
        return F.when(n == 0, "").otherwise(F.concat(head, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), row), ""), F.lit("\n")))

    return let(longest, build)


#: Chart tags to names; the first tag in a chart holds.
CHARTS = (
    ("<c:barChart>", "Bar Chart"),
    ("<c:bar3DChart>", "3D Bar Chart"),
    ("<c:lineChart>", "Line Chart"),
    ("<c:line3DChart>", "3D Line Chart"),
    ("<c:pieChart>", "Pie Chart"),
    ("<c:pie3DChart>", "3D Pie Chart"),
    ("<c:areaChart>", "Area Chart"),
    ("<c:scatterChart>", "Scatter Chart"),
    ("<c:doughnutChart>", "Doughnut Chart"),
    ("<c:radarChart>", "Radar Chart"),
)


def chart_type(xml: Column) -> Column:
    out = F.lit("")
    for tag, name in reversed(CHARTS):
        out = F.when(xml.contains(tag), name).otherwise(out)
    return out


def chart_title(xml: Column) -> Column:
    block = F.regexp_extract(xml, r"(?s)<c:title>(.*?)</c:title>", 1)
    return let(block, lambda b: F.coalesce(F.nullif(F.regexp_extract(b, r"(?s)<a:t>(.*?)</a:t>", 1), F.lit("")), F.regexp_extract(b, r"(?s)<c:v>(.*?)</c:v>", 1)))
