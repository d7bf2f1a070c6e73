"""Text kernel: trimming, cleaning, names, look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points of the Unicode property White_Space.
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space of regular expressions: without VT.
GAP = r"[\t\n\f\r ]"

#: Extension to format; all others are markdown.
FORMATS = {".md": "markdown", ".markdown": "markdown", ".csv": "csv", ".xlsx": "xlsx", ".xls": "xls", ".txt": "txt", ".html": "html", ".htm": "html"}
#: What a batch scan takes, and file names that it leaves out.
BATCH_EXTENSIONS = (".md", ".markdown", ".csv", ".xlsx", ".txt", ".html", ".htm")
BATCH_SKIPS = ("readme.md", "claude.md")

#: Words in a title by document type; the first type with a word in the title holds.
TYPE_WORDS = (
    ("agreement", ("agreement", "līgums", "nda", "contract")),
    ("policy", ("policy", "privacy", "terms", "noteikumi")),
    ("corporate", ("lēmums", "decision", "protokol")),
    ("technical", ("spec", "technical", "api", "architecture")),
    ("report", ("report", "analysis", "review")),
    ("letter", ("letter", "correspondence")),
    ("internal", ("plan", "budget", "roadmap", "checklist")),
    ("invoice", ("invoice", "rēķins", "bill", "receipt")),
    ("memo", ("memo", "memorandum", "notice", "announcement")),
    ("academic", ("paper", "thesis", "dissertation", "journal", "research", "study")),
)
#: Style by document type; all others are report.
TYPE_STYLES = {"agreement": "legal", "policy": "legal", "corporate": "legal", "technical": "technical", "letter": "letter", "academic": "academic", "invoice": "invoice", "memo": "memo"}
#: Words that call for signatures in a legal document's title.
SIGNATURE_WORDS = ("agreement", "contract", "nda", "ligums", "līgums")
STYLES = ("legal", "technical", "report", "minimal", "letter", "academic", "invoice", "memo", "ligums")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def steps(value: Column, *bodies: Callable[[Column], Column]) -> Column:
    """Bodies one after another; a body that needs its input more than once binds it by :func:`let` itself."""
    for body in bodies:
        value = body(value)
    return value


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return trimmed(c) == ""


def clean_text(c: Column) -> Column:
    """Trimmed, white space inside collapsed to single spaces."""
    return F.regexp_replace(trimmed(c), GAP + "+", " ")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def collapse_blank_lines(c: Column) -> Column:
    """At most one blank line in a row, no blanks at line ends, one line break at the end."""
    return steps(c, lambda s: F.regexp_replace(s, r"\n{3,}", "\n\n"), lambda s: F.regexp_replace(s, r"[ \t]++(?=\n|\z)", ""), lambda s: F.concat(trimmed(s), F.lit("\n")))


def replace_each(c: Column, pattern: str, groups: int, make: Callable[..., Column]) -> Column:
    """Every match of ``pattern`` replaced by ``make(whole, group 1, ...)``.

    The text is split at the matches and zipped with what is made of them; matches must not be empty.  Groups are read from each match
    alone, so the pattern must not look around or ask for the text's ends.
    """

    def build(gaps: Column, s: Column) -> Column:
        found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
        made = F.transform(found, lambda w: make(w, *(F.regexp_extract(w, pattern, i) for i in range(1, groups + 1))))
        joined = F.zip_with(gaps, F.concat(made, F.array(F.lit(""))), lambda gap, m: F.concat(gap, m))
        return F.when(F.size(gaps) > 1, F.array_join(joined, "")).otherwise(s)

    return let(c, lambda s: let(F.split(s, pattern), lambda gaps: build(gaps, s)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """The last extension, its dot included, lower-case; empty if the name has no dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def detect_format(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("markdown")
    for e, name in FORMATS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def in_batch(path: Column) -> Column:
    return extension(path).isin(*BATCH_EXTENSIONS) & ~F.lower(base_name(path)).isin(*BATCH_SKIPS)


def output_path(path: Column, new_extension: str = ".pdf") -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*\z", ""), F.lit(new_extension))


def title_from_filename(path: Column) -> Column:
    """Dashes and underscores to spaces, words with a capital first letter and the rest as it is."""
    stem = F.translate(F.regexp_replace(base_name(path), r"\.[^.]*\z", ""), "-_", "  ")
    words = F.filter(F.split(stem, r"\p{IsWhite_Space}+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), " ")


def count_of(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def csv_delimiter(content: Column) -> Column:
    """Tab if the first line has more tabs than either other mark, semicolon if more of these than commas, else comma."""
    return let(F.substring_index(content, "\n", 1), lambda s: F.when((count_of(s, "\t") > count_of(s, ",")) & (count_of(s, "\t") > count_of(s, ";")), "\t").when(count_of(s, ";") > count_of(s, ","), ";").otherwise(","))


def doc_type(title: Column) -> Column:
    def match(t: Column) -> Column:
        out = F.lit("document")
        for name, words in reversed(TYPE_WORDS):
            out = F.when(t.rlike("|".join(words)), name).otherwise(out)
        return out

    return let(F.lower(title), match)


def style_for(kind: Column) -> Column:
    out = F.lit("report")
    for k, style in TYPE_STYLES.items():
        out = F.when(kind == k, style).otherwise(out)
    return out


def needs_signatures(style: Column, title: Column) -> Column:
    return (style == "legal") & F.lower(title).rlike("|".join(SIGNATURE_WORDS))


def known_style(style: Column) -> Column:
    """The style whose template is used: names are case-sensitive, unknown ones mean report."""
    return F.when(style.isin(*STYLES), style).otherwise("report")


def status_color(status: Column) -> Column:
    return F.when(status.isin("FINAL", "ACTIVE"), "statusgreen").when(status == "DRAFT", "statusamber").when(status == "TEMPLATE", "statusblue").otherwise("medgray")


def class_label(classification: Column) -> Column:
    return F.when(classification == "CONFIDENTIAL", "CONFIDENTIAL").when(classification == "INTERNAL", "INTERNAL USE ONLY").when(classification == "PUBLIC", "PUBLIC").otherwise("")


def section_command(level: Column) -> Column:
    return F.when(level == 1, "section").when(level == 2, "subsection").when(level == 3, "subsubsection").otherwise("paragraph")


def first_filled(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def error_summary(log: Column) -> Column:
    """The first five lines of a log that look like errors, else its last ten."""

    def pick(lines: Column) -> Column:
        errors = F.filter(lines, lambda x: x.startswith("!") | x.contains("Error") | x.contains("Undefined control sequence") | x.contains("Missing"))
        return let(errors, lambda e: F.array_join(F.when(F.size(e) > 0, F.slice(e, 1, 5)).otherwise(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 9), 10)), "\n"))

    return let(F.split(log, "\n"), pick)


def cell_ref(ref: Column) -> Column:
    """B3 to struct(col 2, row 3): letters A-Z only, 1-based; what is no number after them gives row 0."""

    def build(letters: Column) -> Column:
        col = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: acc * 26 + F.ascii(x) - 64)
        return F.struct(col.alias("col"), F.coalesce(F.substring(ref, F.length(letters) + 1, F.length(ref)).try_cast("long"), F.lit(0).cast("long")).alias("row"))

    return let(F.regexp_extract(ref, "^([A-Z]*)", 1), build)


def cell_value(kind: Column, value: Column, shared: Column, inline: Column, runs: Column) -> Column:
    """What a spreadsheet cell shows: shared strings by index (a bad index shows itself), inline text or its runs, Yes or No, else the raw value."""
    index = value.try_cast("int")
    from_shared = F.coalesce(F.when(index >= 0, F.get(shared, index)), value)
    return F.when(kind == "s", from_shared).when(kind == "inlineStr", F.when(inline != "", inline).otherwise(F.array_join(runs, ""))).when(kind == "b", F.when(value == "1", "Yes").otherwise("No")).otherwise(value)
