"""Nine document styles as data; ``render`` builds one page frame from them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Style:
    """Slots of a style.  Header and footer slots name the field that fills them unless the document overrides them; empty: no such slot."""

    margin_v: str
    margin_h: str
    stretch: str
    title: str = "page"  # page, inline, none
    toc: bool = True
    signatures: bool = False
    header_left: str = "title"
    header_right: str = ""
    footer_left: str = ""
    footer_right: str = ""
    fields: tuple[str, ...] = ("summary", "author", "date", "version")
    logo: bool = False
    numbered: bool = True
    summary_always: bool = False


#: Default margins, line spacing and slots of each style.
STYLES = {
    "legal": Style("3.2cm", "3cm", "1.25", signatures=True, header_right="class_label", footer_left="status", footer_right="none", fields=("summary", "author", "date", "version", "status", "class_label", "generated"), logo=True),
    "technical": Style("2.5cm", "2cm", "1.2", header_right="version_only", logo=True),
    "report": Style("2.8cm", "2.5cm", "1.3", header_right="date", fields=("summary", "author", "date", "version", "status"), logo=True),
    "minimal": Style("3cm", "3cm", "1.3", title="inline", header_left="", summary_always=True),
    "letter": Style("3cm", "3cm", "1.3", title="none", toc=False, signatures=True, header_left="", fields=("author", "date_or_generated", "subject"), logo=True),
    "academic": Style("2.5cm", "3cm", "1.5", title="inline", header_right="author"),
    "invoice": Style("2cm", "2.5cm", "1.15", title="none", toc=False, signatures=True, header_left="", footer_left="none", footer_right="none", fields=("summary", "author", "date", "version", "status"), logo=True, summary_always=True),
    "memo": Style("2.5cm", "2.5cm", "1.25", title="none", header_left="memo", header_right="date", fields=("subtitle", "author", "date_or_generated", "summary"), logo=True, summary_always=True),
    "ligums": Style("3cm", "3cm", "1.25", header_right="empty", numbered=False),
}
