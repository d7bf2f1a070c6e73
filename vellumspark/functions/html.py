"""HTML to Markdown as column functions.  The order of the steps is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import entity_decoder
from .text import GAP, clean_text, collapse_blank_lines, is_blank, let, replace_each, steps, strip_tags, title_from_filename, trimmed

DROPPED = ("script", "style", "head", "nav", "footer")


def element(tag: str, inner: str = "(.+?)", close: str | None = None) -> str:
    """The pattern of an element; its text, at least one character, is the first group."""
    return rf"(?isu)<{tag}(?:{GAP}[^>]*)?>{inner}</{close or tag}{GAP}*>"


def extract_tag(s: Column, tag: str) -> Column:
    return F.regexp_extract(s, element(tag), 1)


def remove_tag(s: Column, tag: str) -> Column:
    return F.regexp_replace(s, element(tag, ".*?"), "")


def html_title(s: Column, path: Column) -> Column:
    first = F.coalesce(F.nullif(extract_tag(s, "title"), F.lit("")), F.nullif(extract_tag(s, "h1"), F.lit("")), title_from_filename(path))
    return clean_text(first)


def html_body(s: Column) -> Column:
    """The body's content, or everything where there is none, without scripts, styles, heads, navigation and footers."""
    body = let(extract_tag(s, "body"), lambda b: F.when(b != "", b).otherwise(s))
    return steps(body, *(lambda x, t=tag: remove_tag(x, t) for tag in DROPPED))


def spaced(*parts: Column) -> Column:
    return F.concat(F.lit("\n\n"), *parts, F.lit("\n\n"))


def headings(s: Column) -> Column:
    def level(n: int):
        return lambda x: replace_each(x, element(f"h{n}"), 1, lambda _, inner: spaced(F.lit("#" * n + " "), clean_text(strip_tags(inner))))

    return steps(s, *(level(n) for n in range(6, 0, -1)))


def code_blocks(s: Column) -> Column:
    pattern = rf"(?isu)<pre(?:{GAP}[^>]*)?>(?:<code(?:{GAP}[^>]*)?>)?(.+?)(?:</code{GAP}*>)?</pre{GAP}*>"
    language = lambda whole: F.regexp_extract(whole, r'(?iu)class="[^"]*(?:language-|lang-)([0-9A-Za-z_]+)', 1)
    return replace_each(s, pattern, 1, lambda whole, inner: spaced(F.lit("```"), language(whole), F.lit("\n"), trimmed(common_entities(strip_tags(inner))), F.lit("\n```")))


def block_quotes(s: Column) -> Column:
    return replace_each(s, element("blockquote"), 1, lambda _, inner: spaced(F.lit("> "), clean_text(strip_tags(inner))))


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""))


def pad_row(cells: Column, width: Column) -> Column:
    """Exactly ``width`` cells, filled with empty ones or cut."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def table(whole: Column, inner: Column) -> Column:
    """A pipe table of one table element: without rows it stays, rows without cells vanish."""
    rows = F.regexp_extract_all(inner, F.lit(element("tr")), F.lit(1))
    cells_of = lambda r: F.transform(F.regexp_extract_all(r, F.lit(element("t[hd]")), F.lit(1)), lambda c: clean_text(strip_tags(c)))

    def build(raw: Column) -> Column:
        header = F.exists(raw, lambda r: r.contains("<th"))

        def render(grid: Column) -> Column:
            width = F.array_max(F.transform(grid, F.size))
            line = lambda r: F.concat(pipe_row(pad_row(r, width)), F.lit("\n"))
            rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""), F.lit("\n"))
            rest = F.when(header, F.slice(grid, F.lit(2), F.size(grid))).otherwise(grid)
            return F.concat(F.lit("\n\n"), line(grid[0]), rule, F.array_join(F.transform(rest, line), ""), F.lit("\n"))

        filled = F.filter(F.transform(raw, cells_of), lambda r: F.size(r) > 0)
        return F.when(F.size(raw) == 0, whole).otherwise(let(filled, lambda g: F.when(F.size(g) == 0, F.lit("")).otherwise(render(g))))

    return let(rows, build)


def tables(s: Column) -> Column:
    return replace_each(s, element("table"), 1, table)


def items(inner: Column) -> Column:
    return F.transform(F.regexp_extract_all(inner, F.lit(element("li")), F.lit(1)), lambda t: clean_text(strip_tags(t)))


def lists(s: Column) -> Column:
    bullets = lambda _, inner: F.concat(F.lit("\n"), F.array_join(F.transform(items(inner), lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("\n"))
    numbers = lambda _, inner: F.concat(F.lit("\n"), F.array_join(F.transform(items(inner), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n"), F.lit("\n"))
    return steps(s, lambda x: replace_each(x, element("ul"), 1, bullets), lambda x: replace_each(x, element("ol"), 1, numbers))


def paragraphs(s: Column) -> Column:
    return replace_each(s, element("p"), 1, lambda _, inner: spaced(trimmed(inner)))


def rules(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?i)<hr{GAP}*/?{GAP}*>", "\n\n---\n\n")


def inline(s: Column) -> Column:
    pair = lambda tags, mark: lambda x: F.regexp_replace(x, element(f"(?:{tags})"), f"{mark}$1{mark}")
    return steps(s, pair("strong|b", "**"), pair("em|i", "*"), pair("code", "`"), pair("del|s|strike", "~~"), lambda x: F.regexp_replace(x, rf"(?i)<br{GAP}*/?{GAP}*>", "\n"))


def links(s: Column) -> Column:
    pattern = rf'(?isu)<a{GAP}[^>]*href="([^"]*)"[^>]*>(.+?)</a{GAP}*>'

    def make(_: Column, href: Column, inner: Column) -> Column:
        text = clean_text(strip_tags(inner))
        return F.when(href.isin("", "#"), text).otherwise(F.concat(F.lit("["), text, F.lit("]("), href, F.lit(")")))

    return replace_each(s, pattern, 2, make)


def images(s: Column) -> Column:
    pattern = rf'(?isu)<img{GAP}[^>]*src="([^"]*)"[^>]*/?{GAP}*>'
    alt = lambda whole: F.regexp_extract(whole, r'(?iu)alt="([^"]*)"', 1)
    return replace_each(s, pattern, 1, lambda whole, src: F.concat(F.lit("!["), alt(whole), F.lit("]("), src, F.lit(")")))


#: Entities decoded without leaving the JVM; the ampersand comes last.
COMMON = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def common_entities(s: Column) -> Column:
    return steps(s, *(lambda x, a=a, b=b: F.replace(x, F.lit(a), F.lit(b)) for a, b in COMMON))


def decode_entities(s: Column) -> Column:
    """All HTML entities.  Texts whose ampersands all begin common entities stay in the JVM; only the others go to Python, in Arrow batches."""
    rare = F.regexp_like(s, F.lit(r"&(?!(?:lt|gt|quot|apos|nbsp|copy|middot|amp|#34|#39);)[A-Za-z#]"))
    return F.when(rare, entity_decoder()(F.when(rare, s))).otherwise(common_entities(s))


def body_markdown(s: Column, decode=common_entities) -> Column:
    """All steps from the body on."""
    return steps(html_body(s), headings, code_blocks, block_quotes, tables, lists, paragraphs, rules, inline, links, images, strip_tags, decode, collapse_blank_lines)


def html_to_markdown(s: Column, path: Column, decode=common_entities) -> Column:
    """Canonical text of a page; null for a page without text, which is an error.

    ``decode`` may be :func:`decode_entities` outside of lambda functions only; the common entities need no Python.
    """
    body = body_markdown(s, decode)
    return F.when(~is_blank(s), F.concat(F.lit("---\ntitle: "), html_title(s, path), F.lit("\n---\n\n"), body))
