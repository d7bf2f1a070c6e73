"""Inline Markdown to LaTeX as column functions; they work on escaped text, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, replace_each, steps, trimmed

#: Symbols that fonts lack: all beyond U+1F000, some blocks, and other symbols above Latin-1.
EMOJI = r"[\x{1F001}-\x{10FFFF}\x{2600}-\x{27BF}\x{2B50}-\x{2B55}\x{FE00}-\x{FE0F}\x{200D}]|[\p{So}&&[^\x{0}-\x{FF}]]"
#: Characters that take a backslash.
SPECIAL = "&%$#_{}"
BACKSLASH, TILDE, CARET = r"\textbackslash{}", r"\textasciitilde{}", r"\textasciicircum{}"
#: Fence tags to names of the listings package; empty means none.
LANGUAGES = {
    "go": "Go",
    "golang": "Go",
    "python": "Python",
    "py": "Python",
    "javascript": "Java",
    "js": "Java",
    "typescript": "Java",
    "ts": "Java",
    "java": "Java",
    "c": "C",
    "cpp": "C++",
    "c++": "C++",
    "csharp": "C",
    "cs": "C",
    "ruby": "Ruby",
    "rb": "Ruby",
    "rust": "C",
    "bash": "bash",
    "sh": "bash",
    "shell": "bash",
    "zsh": "bash",
    "sql": "SQL",
    "html": "HTML",
    "xml": "XML",
    "css": "HTML",
    "json": "Java",
    "yaml": "bash",
    "yml": "bash",
    "toml": "bash",
    "markdown": "bash",
    "md": "bash",
    "tex": "TeX",
    "latex": "TeX",
    "r": "R",
    "perl": "Perl",
    "php": "PHP",
    "lua": "Lua",
    "make": "make",
    "makefile": "make",
    "dockerfile": "bash",
    "text": "",
    "plain": "",
}


def swap(c: Column, *pairs: tuple[str, str]) -> Column:
    return steps(c, *(lambda x, a=a, b=b: F.replace(x, F.lit(a), F.lit(b)) for a, b in pairs))


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def escape_latex(c: Column) -> Column:
    """Specials escaped; those whose escape holds braces are parked meanwhile."""
    parked = (("\\", "\x00B\x00"), ("~", "\x00T\x00"), ("^", "\x00C\x00"))
    back = (("\x00B\x00", BACKSLASH), ("\x00T\x00", TILDE), ("\x00C\x00", CARET))
    return swap(strip_emoji(c), *parked, *((x, "\\" + x) for x in SPECIAL), *back)


def unescape_math(c: Column) -> Column:
    return swap(c, (r"\_", "_"), (r"\{", "{"), (r"\}", "}"), (CARET, "^"), (r"\#", "#"), (r"\&", "&"))


def display_math(c: Column) -> Column:
    return replace_each(c, r"(?d)\\\$\\\$(.+?)\\\$\\\$", 1, lambda _, x: F.concat(F.lit(r"\["), unescape_math(x), F.lit(r"\]")))


def inline_math(c: Column) -> Column:
    return replace_each(c, r"\\\$([^$]+?)\\\$", 1, lambda _, x: F.concat(F.lit("$"), unescape_math(x), F.lit("$")))


def bold_italic(c: Column) -> Column:
    """Underscores and tildes are escaped by now, so stars alone count."""
    return steps(c, lambda x: F.regexp_replace(x, r"(?d)\*\*(.+?)\*\*", r"\\textbf{$1}"), lambda x: F.regexp_replace(x, r"(?d)\*(.+?)\*", r"\\textit{$1}"))


def inline_code(c: Column) -> Column:
    raw = ((BACKSLASH, "\\"), *(("\\" + x, x) for x in "&%$#_{}"), (TILDE, "~"), (CARET, "^"))
    again = (("\\", BACKSLASH), ("~", TILDE), ("^", CARET), *((x, "\\" + x) for x in "_#$%&{}"))
    return replace_each(c, "`([^`]+)`", 1, lambda _, x: F.concat(F.lit(r"\texttt{"), swap(x, *raw, *again), F.lit("}")))


def links(c: Column) -> Column:
    def make(_: Column, text: Column, escaped: Column) -> Column:
        def target(url: Column) -> Column:
            href = swap(url, ("#", r"\#"), ("%", r"\%"))
            linked = F.concat(F.lit(r"\href{"), href, F.lit("}{"), text, F.lit("}"))
            noted = F.concat(linked, F.lit(r"\footnote{\url{"), url, F.lit("}}"))
            page = url.endswith(".md") | url.contains(".md#")
            return F.when(url.startswith("#"), text).when(page, F.concat(F.lit(r"\textbf{"), text, F.lit("}"))).when(url.contains("#"), linked).otherwise(noted)

        return let(swap(escaped, (r"\_", "_"), (r"\#", "#"), (r"\%", "%"), (r"\&", "&"), (TILDE, "~")), target)

    return replace_each(c, r"\[([^\]]+)\]\(([^)]+)\)", 2, make)


def footnote_refs(c: Column, notes: Column) -> Column:
    """References by ``notes`` (map id to text); unknown ones stay."""
    known = lambda whole, key: let(F.try_element_at(notes, key), lambda t: F.when(t.isNull(), whole).otherwise(F.concat(F.lit(r"\footnote{"), escape_latex(t), F.lit("}"))))
    return replace_each(c, r"\[\\textasciicircum\{\}([0-9A-Za-z_]+)\]", 1, known)


def citations(c: Column) -> Column:
    return F.regexp_replace(c, r"\[@([^\]]+)\]", r"\\textsuperscript{[$1]}")


def inline_format(c: Column, notes: Column) -> Column:
    return steps(c, display_math, inline_math, bold_italic, inline_code, links, lambda x: footnote_refs(x, notes), citations)


def is_separator(line: Column) -> Column:
    return line.rlike(r"^\|[-\t\n\f\r |:]+\|\z")


def is_table_row(line: Column) -> Column:
    return line.startswith("|") & line.endswith("|")


def table_cells(line: Column) -> Column:
    """Cells of a pipe row: all outer pipes go, cells are trimmed."""
    return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), trimmed)


def table_row(cells: Column, header: bool, notes: Column) -> Column:
    one = lambda c: inline_format(escape_latex(c), notes)
    return F.array_join(F.transform(cells, (lambda c: F.concat(F.lit(r"\textbf{"), one(c), F.lit("}"))) if header else one), " & ")


def merge_excess(cells: Column, width: Column) -> Column:
    """Cells beyond the header's are joined into the last one."""
    joined = F.array(F.array_join(F.slice(cells, width, F.size(cells)), " | "))
    return F.when((width > 0) & (F.size(cells) > width), F.concat(F.slice(cells, F.lit(1), width - 1), joined)).otherwise(cells)


def listing_language(tag: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(tag)), F.lit(""))


def listing_begin(tag: Column) -> Column:
    return let(listing_language(tag), lambda n: F.concat(F.lit(r"\begin{lstlisting}["), F.when(n != "", F.concat(F.lit("language="), n, F.lit(","))).otherwise(""), F.lit("style=codestyle]")))


def clean_path(path: Column) -> Column:
    """Without empty and single-dot parts; double-dot parts take the one before with them."""

    def fold(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(part)))

    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    rooted = path.startswith("/")
    done = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, p: F.when(rooted & (p == "..") & (F.size(acc) == 0), acc).otherwise(F.when(F.size(acc) == 0, F.array(p)).otherwise(fold(acc, p))))
    return let(done, lambda d: F.concat(F.when(rooted, "/").otherwise(""), F.when(F.size(d) == 0, F.when(rooted, "").otherwise(".")).otherwise(F.array_join(d, "/"))))


def figure(line: Column, input_dir: Column) -> Column:
    """The figure of a line that is one image, else null."""
    pattern = r"^!\[([^\]]*)\]\(([^)]+)\)\z"
    alt, src = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    path = F.when(~src.startswith("/") & (input_dir != ""), clean_path(F.concat(input_dir, F.lit("/"), src))).otherwise(src)
    caption = F.when(alt != "", F.concat(F.lit("\n\\caption{"), escape_latex(alt), F.lit("}"))).otherwise("")
    body = F.concat(F.lit("\\begin{figure}[htbp]\n\\centering\n\\includegraphics[max width=\\textwidth, max height=0.4\\textheight]{"), path, F.lit("}"), caption, F.lit("\n\\end{figure}"))
    return F.when(line.rlike(pattern), body)


def quote_box(lines: Column, notes: Column) -> Column:
    """A box of block-quote lines, marks included; a blank line between each two."""
    inner = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), "^> ", ""), "^>", ""))
    return F.concat(F.lit("\\begin{quotebox}\n"), inline_format(escape_latex(F.array_join(inner, "\n\n")), notes), F.lit("\n\\end{quotebox}"))


def is_rule(line: Column) -> Column:
    return line.isin("---", "***", "___")


def list_kind(line: Column) -> Column:
    """itemize, enumerate, or null for a trimmed line that is no item."""
    return F.when(line.rlike(r"^[-*+] "), "itemize").when(line.rlike(r"^[0-9]+\.[\t\n\f\r ]"), "enumerate")


def item_text(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:- \[[ xX]\] |[-*+] |[0-9]+\.[\t\n\f\r ])", "")


def task_mark(line: Column) -> Column:
    return F.when(line.rlike(r"^- \[[xX]\] "), r"$\boxtimes$ ").when(line.startswith("- [ ] "), r"$\square$ ").otherwise("")


def list_depth(line: Column) -> Column:
    lead = F.regexp_extract(line, "^([ \t]*)", 1)
    return F.floor((F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit(""))))) / 2).cast("int")
