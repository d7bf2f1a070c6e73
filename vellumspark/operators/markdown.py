"""Canonical Markdown to a document record, row by row inside the JVM: no shuffle, no Python.

Only fences and headings are looked at one by one; everything else is slices of the line array, so that the work grows with the length of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, doc_type, let, needs_signatures, style_for, trimmed

#: The record's fields, in order.
FIELDS = (
    *("title", "subtitle", "date", "version", "status", "doc_type", "style", "summary", "author", "language", "classification", "toc", "no_title_page", "has_signatures", "font_size"),
    *("header_left", "header_right", "footer_left", "footer_right", "margin_top", "margin_bottom", "margin_left", "margin_right", "logo", "raw_preamble", "sections", "footnotes"),
)
EMPTY_MAP = "cast(map() as map<string,string>)"


def rest(a: Column, start: Column | int) -> Column:
    return F.slice(a, start if isinstance(start, Column) else F.lit(start), F.greatest(F.lit(0), F.size(a)))


def split_frontmatter(lines: Column) -> Column:
    """struct(front, body): front are the lines between the first line and the next that are ---; none if it is not closed."""
    tail = rest(lines, 2)
    bar = lambda x: x.contains("---") & (trimmed(x) == "---")
    end = F.when(bar(lines[0]), F.array_position(F.transform(tail, bar), True)).otherwise(0).cast("int")

    def cut(e: Column) -> Column:
        none = F.expr("cast(array() as array<string>)")
        return F.struct(F.when(e > 0, F.slice(tail, F.lit(1), e - 1)).otherwise(none).alias("front"), F.when(e > 0, rest(tail, e + 1)).otherwise(lines).alias("body"))

    return let(end, cut)


def clean_value(raw: Column) -> Column:
    """Trimmed; a quoted literal without its quotes and with its simple escapes resolved, else without equal outer quotes."""

    def unquote(v: Column) -> Column:
        inner = F.substring(v, F.lit(2), F.length(v) - 2)
        plain = v.rlike(r'(?s)^"(?:[^"\\\n]|\\[abfnrtv\\"])*"\z')
        escapes = (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\a", "\x07"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\x0b"), ("\x00", "\\"))
        literal = inner
        for a, b in escapes:
            literal = F.replace(literal, F.lit(a), F.lit(b))
        back = v.rlike(r"(?s)^`[^`]*`\z")
        quoted = v.rlike(r"""(?s)^(?:'.*'|".*")\z""")
        return F.when(F.length(v) < 2, v).when(plain, trimmed(literal)).when(back, trimmed(F.replace(inner, F.lit("\r"), F.lit("")))).when(quoted, trimmed(inner)).otherwise(v)

    return let(trimmed(raw), unquote)


def frontmatter(lines: Column) -> Column:
    """array<struct<key,value>> of lines with a colon and a value, keys in lower case."""
    entry = lambda x: F.struct(F.lower(trimmed(F.substring_index(x, ":", 1))).alias("key"), clean_value(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))
    return F.filter(F.transform(F.filter(lines, lambda x: x.contains(":")), entry), lambda e: e["value"] != "")


def last_value(entries: Column, *keys: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"].isin(*keys)), F.lit(-1))["value"]


def is_note(line: Column) -> Column:
    return line.contains("]:") & let(trimmed(line), lambda t: t.startswith("[^") & t.contains("]:"))


def footnotes(lines: Column) -> Column:
    """map id to text of footnote lines; the last one of an id holds, lines without an id are dropped."""

    def note(t: Column) -> Column:
        at = F.instr(t, "]:")
        return F.struct(F.substring(t, F.lit(3), at - 3).alias("id"), trimmed(F.substring(t, at + 2, F.length(t))).alias("text"))

    found = F.filter(F.transform(F.filter(lines, is_note), lambda x: let(trimmed(x), note)), lambda n: n["id"] != "")

    def unique(n: Column) -> Column:
        ids = F.array_distinct(F.transform(n, lambda x: x["id"]))
        last = F.transform(ids, lambda i: F.element_at(F.filter(n, lambda x: x["id"] == i), -1)["text"])
        return F.when(F.size(n) == 0, F.expr(EMPTY_MAP)).otherwise(F.map_from_arrays(ids, last))

    return let(found, unique)


#: Lines that matter to the line machine: code fences, with any white space before them, and headings.
MARKED = rf"^(?:[{WHITE}]*```|#{{1,4}} )"


def headings(lines: Column) -> Column:
    """array<struct<level, at>> of the heading lines outside of code fences, at from 1.

    Marked lines become a text such as ``1@3;`@7;2@8;`@9;``, in which one expression takes out everything from a fence to the next, both included.
    """
    sign = lambda x: F.when(x.startswith("#"), F.length(F.substring_index(x, " ", 1)).cast("string")).otherwise("`")
    marks = F.transform(lines, lambda x, i: F.when(x.rlike(MARKED), F.concat(sign(x), F.lit("@"), (i + 1).cast("string"), F.lit(";"))))
    outside = F.regexp_replace(F.array_join(marks, ""), r"`[^`]*+(?:`[^;]*+;|\z)", "")
    return F.transform(F.filter(F.split(outside, ";"), lambda x: x != ""), lambda x: F.struct(F.substring(x, 1, 1).cast("int").alias("level"), F.substring_index(x, "@", -1).cast("int").alias("at")))


def titled(lines: Column, heads: Column, title: Column) -> Column:
    """struct(title, taken): while the title is empty, level 1 headings are taken for it and are no lines any more."""
    given = F.coalesce(title, F.lit(""))
    ones = F.transform(F.filter(heads, lambda h: h["level"] == 1), lambda h: h["at"])

    def pick(at: Column) -> Column:
        texts = F.transform(at, lambda i: F.substring(lines[i - 1], F.lit(3), F.length(lines[i - 1])))
        first = F.array_position(F.transform(texts, lambda x: x != ""), True).cast("int")
        found = let(first, lambda n: F.struct(F.when(n > 0, F.get(texts, n - 1)).otherwise("").alias("title"), F.when(n > 0, F.slice(at, F.lit(1), n)).otherwise(at).alias("taken")))
        return F.when(given != "", F.struct(given.alias("title"), F.expr("cast(array() as array<int>)").alias("taken"))).otherwise(found)

    return let(ones, pick)


def sections(lines: Column, heads: Column, taken: Column) -> Column:
    """struct(preamble, sections): content lines keep their order and each gets a line break; the preamble's are joined."""
    left = F.when(F.size(taken) > 0, F.transform(lines, lambda x, i: F.when(~F.array_contains(taken, i + 1), x))).otherwise(lines)
    last = F.coalesce(F.try_element_at(taken, F.lit(-1)), F.lit(0))
    cuts = F.when(F.size(taken) > 0, F.filter(heads, lambda h: (h["level"] > 1) | (h["at"] > last))).otherwise(heads)

    def build(x: Column, h: Column) -> Column:
        start = lambda k: F.coalesce(F.get(h, k)["at"], F.size(x) + 1)
        content = lambda a, b: F.array_join(F.concat(F.slice(x, a, F.greatest(F.lit(0), b - a)), F.array(F.lit(""))), "\n")
        section = lambda c, k: F.struct(c["level"].alias("level"), F.ltrim(x[c["at"] - 1], F.lit("# ")).alias("title"), content(c["at"] + 1, start(k + 1)).alias("content"))
        return F.struct(F.array_join(F.slice(x, F.lit(1), start(F.lit(0)) - 1), "\n").alias("preamble"), F.transform(h, section).alias("sections"))

    return let(left, lambda x: let(cuts, lambda h: build(x, h)))


def taken_apart(md: Column, build: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``build`` of the front matter's entries, the lines after it, the title (empty if there is none) and the parts of :func:`sections`."""

    def with_headings(front: Column, body: Column, lines: Column, heads: Column) -> Column:
        return let(titled(lines, heads, last_value(front, "title")), lambda t: let(sections(lines, heads, t["taken"]), lambda s: build(front, body, t["title"], s)))

    def record(front: Column, body: Column) -> Column:
        return let(F.filter(body, lambda x: ~is_note(x)), lambda lines: let(headings(lines), lambda heads: with_headings(front, body, lines, heads)))

    return let(lines_of(md), lambda lines: let(split_frontmatter(lines), lambda p: let(frontmatter(p["front"]), lambda e: record(e, p["body"]))))


def parse(md: Column) -> Column:
    """The document record of a canonical text."""
    return taken_apart(md, fields)


def outline(md: Column) -> Column:
    """The record's preamble and sections only."""
    return taken_apart(md, lambda front, body, title, parts: F.struct(parts["preamble"].alias("raw_preamble"), parts["sections"].alias("sections")))


def metadata(md: Column) -> Column:
    """The record's fields that front matter alone decides; the text after it is not parsed."""
    return let(lines_of(md), lambda lines: let(frontmatter(split_frontmatter(lines)["front"]), lambda e: F.struct(*given_fields(e).values())))


def lines_of(md: Column) -> Column:
    return F.split(F.coalesce(md, F.lit("")), "\n")


def flag(front: Column, *keys: str) -> Column:
    return let(last_value(front, *keys), lambda v: (F.lower(v) == "true") | (v == "yes"))


def given_fields(front: Column) -> dict[str, Column]:
    """Fields that need nothing but front matter, by name."""
    text = lambda key, default="": F.coalesce(last_value(front, key), F.lit(default))
    size = last_value(front, "font-size", "fontsize")
    out = {k.replace("-", "_"): text(k) for k in ("subtitle", "date", "summary", "author", "logo", "header-left", "header-right", "footer-left", "footer-right", "margin-top", "margin-bottom", "margin-left", "margin-right")}
    out |= {
        "version": text("version", "1.0"),
        "status": F.upper(text("status", "DRAFT")),
        "language": F.coalesce(last_value(front, "language", "lang"), F.lit("")),
        "classification": F.upper(text("classification", "CONFIDENTIAL")),
        "toc": flag(front, "toc"),
        "no_title_page": F.coalesce(flag(front, "no-title-page", "notitlepage"), F.lit(False)),
        "font_size": F.when(size == "10", 10).when(size == "12", 12).otherwise(11),
    }
    return {k: v.alias(k) for k, v in out.items()}


def fields(front: Column, body: Column, title: Column, parts: Column) -> Column:
    def build(shown: Column, kind: Column) -> Column:
        style = F.coalesce(last_value(front, "style"), style_for(kind))
        signed = needs_signatures(style, shown) | F.coalesce(flag(front, "signatures"), F.lit(False))
        found = {"title": shown, "doc_type": kind, "style": style, "has_signatures": signed, "raw_preamble": parts["preamble"], "sections": parts["sections"], "footnotes": footnotes(body)}
        both = given_fields(front) | {k: v.alias(k) for k, v in found.items()}
        return F.struct(*(both[k] for k in FIELDS))

    return let(F.when(title != "", title).otherwise("Document"), lambda shown: let(F.coalesce(last_value(front, "type"), doc_type(shown)), lambda kind: build(shown, kind)))


def show_toc(doc: Column) -> Column:
    return F.coalesce(doc["toc"], F.size(doc["sections"]) >= 3)


def passes(doc: Column) -> Column:
    return F.when(show_toc(doc), 2).otherwise(1)


def documents(df: DataFrame, md_col: str = "md") -> DataFrame:
    """``df`` with the record in ``doc``.  Null text is an empty document; other columns stay."""
    return df.withColumn("doc", parse(F.col(f"`{md_col}`")))


def section_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, section_no, level, title, content), section_no from 1.

    The outer form keeps the optimizer from filtering by the number of sections first, for which it would parse each text twice.
    """
    rows = docs.select(*keys, F.posexplode_outer("doc.sections").alias("section_no", "s")).where("section_no is not null")
    return rows.select(*keys, (F.col("section_no") + 1).alias("section_no"), "s.level", "s.title", "s.content")
