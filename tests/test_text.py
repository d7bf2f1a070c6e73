from pyspark.sql import functions as F

from vellumspark.functions import text


def test_trim_takes_unicode_space(values):
    assert values(text.trimmed, ["\t a\u00a0b \u2003\n", "\x85\u3000", ""]) == ["a\u00a0b", "", ""]


def test_clean_text_keeps_vertical_tab_inside(values):
    assert values(text.clean_text, [" a \n\t b\x0bc ", None]) == ["a b\x0bc", None]


def test_formats(values):
    paths = ["a.MD", "b.markdown", "x/y.Csv", "c.xlsx", "c.xls", "c.txt", "c.htm", "c.html", "noext", "a.b/c", "c.pdf"]
    assert values(text.detect_format, paths) == ["markdown", "markdown", "csv", "xlsx", "xls", "txt", "html", "html", "markdown", "markdown", "markdown"]


def test_batch_takes_known_files_but_not_readmes(values):
    assert values(text.in_batch, ["d/README.md", "d/Claude.MD", "d/x.md", "d/x.xls", "d/x.pdf", "d/readme.txt"]) == [False, False, True, False, False, True]


def test_title_from_filename_keeps_inner_capitals(values):
    assert values(text.title_from_filename, ["/a/my-report_v2.csv", "ÄPFEL_und  birnen.txt", "a.b.c", ".hidden", "x"]) == ["My Report V2", "ÄPFEL Und Birnen", "A.b", "", "X"]


def test_delimiter_ties_go_to_comma(values):
    assert values(text.csv_delimiter, ["a,b", "a;b", "a\tb", "a;b,c", "a\tb,c", "abc", "a;b;c,d", "", "ab\nx;y"]) == [",", ";", "\t", ",", ",", ",", ";", ",", ","]


def test_types_go_by_the_first_word_that_fits(values):
    titles = ["Service Agreement", "Agenda", "Privacy policy", "Capital", "Annual Report", "Cover letter", "Budget", "Invoice 7", "Memo", "Research", "Overview", "LĒMUMS"]
    assert values(text.doc_type, titles) == ["agreement", "agreement", "policy", "technical", "report", "letter", "internal", "invoice", "memo", "academic", "document", "corporate"]


def test_styles_and_signatures(values):
    assert values(text.style_for, ["agreement", "policy", "corporate", "technical", "internal", "memo", "other"]) == ["legal", "legal", "legal", "technical", "report", "memo", "report"]
    assert values(text.needs_signatures, [("legal", "An NDA"), ("legal", "Policy"), ("report", "Contract")], "a", "b") == [True, False, False]


def test_error_summary(values):
    many = "\n".join(f"! e{i}" for i in range(7))
    lines = "\n".join(f"l{i}" for i in range(12))
    assert values(text.error_summary, [many, lines, "", "a\nb Missing c"]) == ["\n".join(f"! e{i}" for i in range(5)), "\n".join(f"l{i}" for i in range(2, 12)), "", "b Missing c"]


def test_cell_ref(values):
    assert [(r["col"], r["row"]) for r in values(text.cell_ref, ["A1", "B3", "Z1", "AA1", "AZ10", "b2", "A", ""])] == [(1, 1), (2, 3), (26, 1), (27, 1), (52, 10), (0, 0), (1, 0), (0, 0)]


def test_replace_each_at_the_edges(values):
    double = lambda s: text.replace_each(s, "<([a-z])>", 1, lambda w, g: F.concat(g, g))
    assert values(double, ["", "none", "<a>", "<a><b>", "x<a>y", "x<a>", None]) == ["", "none", "aa", "aabb", "xaay", "xaa", None]
