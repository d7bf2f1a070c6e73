"""Document records to LaTeX text.  The frame is built by column functions from the style table; bodies come from ``blocks``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.latex import escape_latex
from ..functions.text import class_label, first_filled, is_blank, known_style, let, section_command, status_color
from ..shipping import ship
from .blocks import latex_bodies
from .markdown import FIELDS, show_toc
from .styles import STYLES, Style

PACKAGES = "\n".join(rf"\usepackage{{{p}}}" for p in ("fontspec", "setspace", "graphicx", "tabularx", "booktabs", "xcolor", "listings", "tcolorbox", "amssymb", "tocloft", "fancyhdr", "lastpage", "hyperref"))
COLORS = "\n".join(rf"\definecolor{{{n}}}{{HTML}}{{{v}}}" for n, v in (("rulecolor", "445566"), ("medgray", "808890"), ("statusgreen", "2E8B57"), ("statusamber", "D99A1C"), ("statusblue", "3070B0")))
SETUP = "\n".join((r"\lstdefinestyle{codestyle}{basicstyle=\ttfamily\small,breaklines=true,frame=single}", r"\newtcolorbox{quotebox}{colback=white,colframe=rulecolor,boxrule=0.4pt}", r"\pagestyle{fancy}", r"\fancyhf{}"))


@dataclass(frozen=True)
class Options:
    """What a run may override; empty or None leaves the document's own value."""

    style: str = ""
    title: str = ""
    subtitle: str = ""
    author: str = ""
    language: str = ""
    date: str = ""
    status: str = ""
    classification: str = ""
    summary: str = ""
    toc: bool | None = None
    no_title_page: bool = False
    no_signatures: bool = False
    font_size: int = 0
    template: str = ""


def with_options(doc: Column, o: Options) -> Column:
    """The record with overrides; type and signature detection are not run again.  The record is bound once."""
    given: dict[str, Column] = {n: F.lit(v) for n in ("style", "title", "subtitle", "author", "language", "date", "summary") if (v := getattr(o, n))}
    given |= {n: F.lit(v.upper()) for n in ("status", "classification") if (v := getattr(o, n))}
    if o.toc is not None:
        given["toc"] = F.lit(o.toc)
    if o.no_title_page:
        given["no_title_page"] = F.lit(True)
    if o.no_signatures:
        given["has_signatures"] = F.lit(False)
    if o.font_size > 0:
        given["font_size"] = F.lit(o.font_size)
    return let(doc, lambda d: F.struct(*(given.get(f, d[f]).alias(f) for f in FIELDS))) if given else doc


def line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))


def shown(value: Column, *parts: Column | str) -> Column:
    """A line if the value is not blank."""
    return F.when(~is_blank(value), line(*parts)).otherwise("")


def slot(name: str, doc: Column, generated: Column) -> Column:
    special = {
        "": F.lit(""),
        "none": F.lit(""),
        "empty": F.lit(""),
        "memo": F.lit("Memo"),
        "class_label": class_label(doc["classification"]),
        "version_only": F.concat(F.lit("v"), escape_latex(doc["version"])),
        "generated": generated,
        "date_or_generated": first_filled(escape_latex(doc["date"]), generated),
        "subject": F.concat(F.lit("Re: "), escape_latex(doc["title"])),
    }
    return special[name] if name in special else escape_latex(doc[name])


def frame(s: Style, doc: Column, bodies: Column, generated: Column) -> Column:
    """One style's text."""
    margin = lambda side, default: first_filled(doc[f"margin_{side}"], F.lit(default))
    geometry = line(r"\usepackage[top=", margin("top", s.margin_v), ",bottom=", margin("bottom", s.margin_v), ",left=", margin("left", s.margin_h), ",right=", margin("right", s.margin_h), "]{geometry}")
    marks = []
    for where, default, field in ((r"\fancyhead[L]", s.header_left, "header_left"), (r"\fancyhead[R]", s.header_right, "header_right"), (r"\fancyfoot[L]", s.footer_left, "footer_left"), (r"\fancyfoot[R]", s.footer_right, "footer_right")):
        if default == "memo" or default == "version_only":
            marks.append(line(where, "{", slot(default, doc, generated), "}"))
        elif default:  # what the document gives goes in as it is
            marks.append(line(where, "{", first_filled(doc[field], slot(default, doc, generated)), "}"))
    details = []
    for f in s.fields:
        if f == "summary":
            continue
        value = slot(f, doc, generated)
        text = F.concat(F.lit(r"\textcolor{"), status_color(doc["status"]), F.lit("}{"), value, F.lit("}")) if f == "status" else value
        details.append(shown(value, r"\noindent ", text, r"\par"))
    summary = shown(doc["summary"], r"{\itshape ", escape_latex(doc["summary"]), "}") if "summary" in s.fields else F.lit("")
    logo = F.when(doc["logo"] != "", line(r"\includegraphics[height=1.5cm]{", doc["logo"], "}")).otherwise("") if s.logo else F.lit("")
    head = F.concat(line(r"{\Large\bfseries ", escape_latex(doc["title"]), r"\par}"), shown(doc["subtitle"], r"{\large ", escape_latex(doc["subtitle"]), r"\par}"), *details)
    inside = F.concat(logo, head, F.lit("") if s.summary_always else summary)
    if s.title == "page":
        title = F.when(~doc["no_title_page"], F.concat(line(r"\begin{titlepage}"), inside, line(r"\end{titlepage}"))).otherwise("")
    elif s.title == "inline":
        title = F.when(~doc["no_title_page"], F.concat(line(r"\begin{center}"), inside, line(r"\end{center}"))).otherwise("")
    else:
        title = inside
    toc = F.when(show_toc(doc), line("\\tableofcontents\n\\newpage")).otherwise("") if s.toc else F.lit("")
    sections = F.array_join(F.transform(doc["sections"], lambda x, i: F.concat(line("\\", section_command(x["level"]), "{", escape_latex(x["title"]), "}"), line(bodies[i + 1]))), "")
    signatures = F.when(doc["has_signatures"], line(r"\vspace{2cm}\noindent\rule{6cm}{0.4pt}\hfill\rule{6cm}{0.4pt}")).otherwise("") if s.signatures else F.lit("")
    return F.concat(
        line(r"\documentclass[", doc["font_size"].cast("string"), "pt, a4paper]{article}"),
        geometry,
        line(PACKAGES),
        line(COLORS),
        line(SETUP),
        line(r"\setstretch{" + s.stretch + "}"),
        line("" if s.numbered else r"\setcounter{secnumdepth}{0}"),
        *marks,
        line(r"\hypersetup{pdftitle={", escape_latex(doc["title"]), "},pdfauthor={", escape_latex(doc["author"]), "}}"),
        line(r"\begin{document}"),
        title,
        summary if s.summary_always else F.lit(""),
        toc,
        shown(doc["raw_preamble"], bodies[0]),
        sections,
        signatures,
        F.lit("\\end{document}\n"),
    )


def custom(template: str, doc: Column, bodies: Column) -> Column:
    """A user's template: ``<< name >>`` stands for the escaped field, ``<< body >>`` for preamble and sections."""
    body = F.concat(bodies[0], F.array_join(F.transform(doc["sections"], lambda x, i: F.concat(F.lit("\n\\"), section_command(x["level"]), F.lit("{"), escape_latex(x["title"]), F.lit("}\n"), bodies[i + 1])), ""))
    out = F.lit(template)
    for name in ("title", "subtitle", "author", "date", "version", "status", "classification", "summary"):
        out = F.replace(out, F.lit(f"<< {name} >>"), escape_latex(doc[name]))
    return F.replace(out, F.lit("<< body >>"), body)


def latex(doc: Column, bodies: Column, generated: Column, template: str = "") -> Column:
    if template:
        return custom(template, doc, bodies)

    def pick(style: Column) -> Column:
        out = frame(STYLES["report"], doc, bodies, generated)
        for name, s in STYLES.items():
            if name != "report":
                out = F.when(style == name, frame(s, doc, bodies, generated)).otherwise(out)
        return out

    return let(known_style(doc["style"]), pick)


def rendered(docs: DataFrame, options: Options | None = None, generated_date: str = "1970-01-01", input_dir: str | Column = "") -> DataFrame:
    """``docs`` (with the record in ``doc``) with ``latex``.  The date is a parameter, so that results can be compared;
    ``input_dir``, the same for all or a column, is the folder of relative images."""
    ship(docs.sparkSession)
    one = docs.withColumn("doc", with_options(F.col("doc"), options or Options()))
    texts = F.concat(F.array("doc.raw_preamble"), F.transform("doc.sections", lambda s: s["content"]))
    bodied = one.withColumn("bodies", latex_bodies(texts, F.col("doc.footnotes"), F.lit(input_dir) if isinstance(input_dir, str) else input_dir))
    return bodied.withColumn("latex", latex(F.col("doc"), F.col("bodies"), F.lit(generated_date), (options or Options()).template)).drop("bodies")
