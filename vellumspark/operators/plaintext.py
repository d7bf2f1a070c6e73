"""Plain text to canonical Markdown, row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, let, steps, title_from_filename, trimmed
from .markdown import rest


def is_caps_heading(line: Column) -> Column:
    """3 to 80 bytes with a capital A-Z and no letter a-z."""
    return F.octet_length(line).between(3, 80) & line.rlike("[A-Z]") & ~line.rlike("[a-z]")


def is_underline(line: Column) -> Column:
    return line.rlike(r"^(?:={3,}|-{3,})\z")


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^(?:[-*+] |[0-9]{1,3}[.)] )")


def is_indented(line: Column) -> Column:
    return line.startswith("    ") | line.startswith("\t")


def dedented(line: Column) -> Column:
    return F.when(line.startswith("    "), F.substring(line, F.lit(5), F.length(line))).when(line.startswith("\t"), F.substring(line, F.lit(2), F.length(line))).otherwise(line)


#: From kinds of lines to their tags, in this order: blank lines inside code, the line that opens it, lines that close it, underlines, second blank lines.
TAGGING = ((r"(?<=i)b|(?!^)\Gb", "i"), (r"(?<!i)i", "O"), (r"(?<=[Oi])h", "H"), (r"(?<=[Oi])p", "P"), (r"(?<=[Oi])u", "X"), ("u", "x"), (r"(?<=b)b", "x"))


def line_tags(lines: Column) -> Column:
    """A letter a line: O opens code, i is code, b a kept and x a dropped line, h a heading, p text; capitals H, P, X close code first.

    Each line has a kind of its own (blank, indented, heading, underline, text); what its neighbours make of it is replaced in the text of all kinds.
    """

    def kind(line: Column) -> Column:
        return let(trimmed(line), lambda t: F.when(t == "", "b").when(is_indented(line), "i").when(is_caps_heading(t), "h").when(is_underline(t), "u").otherwise("p"))

    return steps(F.array_join(F.transform(lines, kind), ""), *(lambda s, a=a, b=b: F.regexp_replace(s, a, b) for a, b in TAGGING))


def written(line: Column, tag: Column) -> Column:
    """What a line becomes."""
    t = trimmed(line)
    close = F.when(tag.isin("H", "P", "X"), "```\n\n").otherwise("")
    low = F.lower(tag)
    body = F.when(tag == "O", F.concat(F.lit("```\n"), dedented(line), F.lit("\n"))).when(tag == "i", F.concat(dedented(line), F.lit("\n"))).when(low == "b", "\n").when(low == "h", F.concat(F.lit("## "), t, F.lit("\n\n"))).when(low == "p", F.concat(t, F.lit("\n"))).otherwise("")
    return F.concat(close, body)


def txt_to_markdown(content: Column, path: Column) -> Column:
    """Canonical text: the first line that is not blank is the title.  Null for a blank file, which is an error."""

    def convert(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: ~is_blank(x)), True).cast("int")

        def build(n: Column) -> Column:
            title = F.when(n > 0, trimmed(F.get(lines, n - 1))).otherwise(title_from_filename(path))
            body = rest(lines, n + 1)

            def join(tags: Column) -> Column:
                rows = F.zip_with(body, F.filter(F.split(tags, ""), lambda x: x != ""), written)
                left_open = F.when(tags.rlike(r"[Oi]\z"), "```\n").otherwise("")
                return F.concat(F.lit("---\ntitle: "), title, F.lit("\nstyle: minimal\n---\n\n"), F.array_join(rows, ""), left_open)

            return let(line_tags(body), join)

        return let(first, build)

    return F.when(~is_blank(content), let(F.split(content, "\n"), convert))
