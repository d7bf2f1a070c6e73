"""Odd cases whose results are kept on purpose, one each."""

import pytest

from vellumspark.functions import html, latex
from vellumspark.operators import grid, markdown, plaintext
from vellumspark.operators.blocks import inline, latex_body
from vellumspark.sources import workbook

INLINE = [
    ("two amounts on a line are math", "costs $5 and $6", "costs $5 and $6"),
    ("math keeps commands escaped", r"$\alpha$", r"$\textbackslash{}alpha$"),
    ("percent stays escaped in math", "$5%$", r"$5\%$"),
    ("underscore and tilde marks stay", "_a_ ~~b~~", r"\_a\_ \textasciitilde{}\textasciitilde{}b\textasciitilde{}\textasciitilde{}"),
    ("stars inside code are formatted first", "`*a*`", r"\texttt{\textbackslash\{\}textit\{a\}}"),
    ("braces of a replacement are escaped again in code", "`a~b`", r"\texttt{a\textasciitilde\{\}b}"),
    ("links need both parts", "[a]() [](b)", r"[a]() [](b)"),
    ("unknown notes stay", "[^x]", r"[\textasciicircum{}x]"),
]


@pytest.mark.parametrize(("why", "text", "out"), INLINE, ids=[x[0] for x in INLINE])
def test_inline(why, text, out):
    assert inline(text, {}) == out


def test_blank_cells_are_a_separator_and_the_next_row_is_the_header():
    assert r"\textbf{x}" in latex_body("|  |  |\n| x | y |\n| 1 | 2 |", {})


def test_outer_pipes_all_go(values):
    assert values(latex.table_cells, ["||a||", "|a||b|"]) == [["a"], ["a", "", "b"]]


def test_five_hashes_are_text(values):
    (d,) = values(markdown.parse, ["x\n##### five"])
    assert d["sections"] == [] and d["raw_preamble"].endswith("##### five") and "\\#\\#\\#\\#\\#" in latex_body("##### five", {})


def test_carriage_returns_stay(values):
    (d,) = values(markdown.parse, ["# T\r\n## S\r\nx\r"])
    assert d["title"] == "T\r" and d["sections"][0]["title"] == "S\r" and d["sections"][0]["content"] == "x\r\n"


def test_heading_marks_all_go(values):
    assert values(markdown.parse, ["# T\n## #tag"])[0]["sections"][0]["title"] == "tag"


def test_a_page_title_is_also_a_section_and_keeps_entities(values):
    md = values(lambda s: html.html_to_markdown(s, s), ["<title>A &amp; B</title><body><h1>A</h1></body>"])[0]
    (d,) = values(markdown.parse, [md])
    assert d["title"] == "A &amp; B" and d["sections"][0]["title"] == "A"


def test_code_that_looks_like_a_tag_is_stripped(values):
    assert values(lambda s: html.html_to_markdown(s, s), ["<pre>a &lt;b&gt; c</pre>"])[0].endswith("```\na  c\n```\n")


def test_lists_in_lists_end_at_the_first_close(values):
    assert values(html.lists, ["<ul><li>a<ul><li>b</li></ul></li></ul>"]) == ["\n- ab\n</li></ul>"]


def test_capitals_come_before_lists(values):
    assert "## - ABC\n" in values(lambda s: plaintext.txt_to_markdown(s, s), ["T\n- ABC"])[0]


def test_lengths_are_bytes(values):
    assert values(plaintext.is_caps_heading, ["A" + "é" * 39, "A" + "é" * 40]) == [True, False]


def test_charts_shift_over_blanks(values):
    assert workbook.chart('<c:ser><c:tx><c:v>n</c:v></c:tx><c:cat><c:pt idx="1"><c:v>late</c:v></c:pt></c:cat></c:ser>')["series"][0]["categories"] == ["late"]
    assert values(grid.chart_type, ["<c:lineChart><c:barChart>", "<c:bubbleChart>"]) == ["Bar Chart", ""]


def test_an_absolute_target_skips_the_sheet():
    from .test_sources import sample

    assert [s["name"] for s in workbook.read_book(sample())["sheets"]] == ["One"]


def test_signatures_win_over_a_no(values):
    assert values(markdown.parse, ["---\ntitle: My Contract\nsignatures: false\n---"])[0]["has_signatures"] is True


def test_style_names_are_case_sensitive(values):
    from vellumspark.functions import text

    assert values(text.known_style, ["memo", "Memo", ""]) == ["memo", "report", "report"]
