import io
import time
import zipfile

from pyspark.sql import functions as F

from vellumspark.operators import markdown, render
from vellumspark.operators.styles import STYLES
from vellumspark.sources import delimited, files, workbook
from vellumspark.streaming import watch


def test_records():
    assert delimited.records("a,b\nc", ",") == [["a", "b"], ["c"]]
    assert delimited.records('x,"q ""r"" s",z', ",") == [["x", 'q "r" s', "z"]]
    assert delimited.records('a,b"c,d\n', ",") == [["a", 'b"c', "d"]]
    assert delimited.records("a;  b;\n", ";") == [["a", "b", ""]]
    assert delimited.records('"open, to\nthe end', ",") == [["open, to\nthe end"]]
    assert delimited.records("", ",") == []


def book(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def sample():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return book(
        **{
            "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Gone" sheetId="2" r:id="rId2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/s.xml"/><Relationship Id="rId2" Type="x/worksheet" Target="/xl/none.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {ns}><si><t>Name</t></si><si><r><t>Ri</t></r><r><t>ch</t></r></si></sst>",
            "xl/worksheets/s.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>4.50</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c><c><v>lost</v></c><c r="A4" t="s"><v>99</v></c></row></sheetData></worksheet>',
            "xl/charts/chart1.xml": '<c:chart><c:title><a:t>Sales</a:t></c:title><c:barChart><c:ser><c:tx><c:v>S1</c:v></c:tx><c:cat><c:pt idx="0"><c:v>Q1</c:v></c:pt><c:pt idx="30"><c:v>far</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>5</c:v></c:pt><c:pt idx="1"><c:v>6</c:v></c:pt></c:val></c:ser></c:barChart></c:chart>',
            "xl/media/pic.png": "png",
            "xl/media/x.txt": "no",
        }
    )


def test_workbook():
    got = workbook.read_book(sample())
    assert got["error"] is None and [s["name"] for s in got["sheets"]] == ["One"]
    assert got["sheets"][0]["rows"] == [["Name", "", "Rich"], ["4.50", "Yes", "in"], ["99", "", ""]]
    assert got["charts"] == [{"title": "Sales", "kind": "Bar Chart", "series": [{"name": "S1", "categories": ["Q1"], "values": ["5", "6"]}]}]
    assert [m["file"] for m in got["media"]] == ["pic.png"]
    assert "BadZipFile" in workbook.read_book(b"no")["error"]
    assert workbook.points('<c:val><c:v>a</c:v><c:v>b</c:v></c:val>', "c:val", 3) == ["a", "b", ""]


def corpus(folder):
    (folder / "sub").mkdir()
    (folder / "a.md").write_text("# T\n## S\ntext")
    (folder / "README.md").write_text("no")
    (folder / "sub/b.csv").write_text("x;y\n1;2\n")
    (folder / "c.txt").write_text("Title\nBODY HERE\nx")
    (folder / "d.html").write_text("<title>P</title><h2>Q</h2><p>a &eacute;</p>")
    (folder / "e.html").write_text("  ")
    (folder / "f.xlsx").write_bytes(sample())
    (folder / "g.pdf").write_text("no")


def test_folder_to_latex(spark, tmp_path):
    corpus(tmp_path)
    got = files.canonical(files.scan(spark, str(tmp_path))).cache()
    rows = {r["path"].rpartition("/")[2]: r for r in got.collect()}
    assert sorted(rows) == ["a.md", "b.csv", "c.txt", "d.html", "e.html", "f.xlsx"]
    assert rows["e.html"]["error"] == "HTML file is empty" and rows["e.html"]["md"] is None
    assert rows["d.html"]["md"] == "---\ntitle: P\n---\n\nP\n\n## Q\n\na é\n"
    assert "| x | y |" in rows["b.csv"]["md"] and "## BODY HERE" in rows["c.txt"]["md"]
    assert "## One" in rows["f.xlsx"]["md"] and "*Chart type: Bar Chart*" in rows["f.xlsx"]["md"] and "/pic.png)" in rows["f.xlsx"]["md"]
    assert files.summary(got).first().asDict() == {"total": 6, "success": 5}
    done = render.rendered(markdown.documents(got.where("error is null")), render.Options(toc=True))
    texts = [r["latex"] for r in done.select("latex").collect()]
    assert len(texts) == 5 and all(t.startswith(r"\documentclass") and t.endswith("\\end{document}\n") and "\x00" not in t for t in texts)
    assert [r["file"] for r in files.media(files.scan(spark, str(tmp_path))).collect()] == ["pic.png"]


def test_every_style_renders(spark):
    md = "---\ntitle: A & B\nauthor: X\ndate: 2024\nsummary: Sum\nsignatures: true\nheader-right: HR_raw\n---\npre\n## S\n- a\n## T\n## U\n"
    base = markdown.documents(spark.createDataFrame([(md,)], "md string"))
    for name, style in STYLES.items():
        (t,) = (r["latex"] for r in render.rendered(base, render.Options(style=name), "2024-02-03").select("latex").collect())
        assert r"A \& B" in t and r"\subsection{S}" in t and ("tableofcontents" in t) == style.toc, name
        assert f"setstretch{{{style.stretch}}}" in t and (r"\rule{6cm}" in t) == style.signatures and ("Sum" in t) == (name != "letter")
        assert ("HR_raw" in t) == (style.header_right not in ("", "version_only")), name
    plain = render.rendered(base, render.Options(no_title_page=True, template="<< title >>|<< body >>")).select("latex").first()["latex"]
    assert plain.startswith(r"A \& B|pre")


def test_watch_converts_new_files(spark, tmp_path):
    folder, done = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.md").write_text("# One")
    handle = lambda batch, n: done.extend((r["path"].rpartition("/")[2], r["error"]) for r in batch.collect())
    for _ in range(2):
        q = watch.convert_stream(watch.watched(spark, str(folder)), handle, str(tmp_path / "ck"), once=True).start()
        q.awaitTermination(60)
        time.sleep(1)
        (folder / "b.html").write_text(" ")
    assert done == [("a.md", None), ("b.html", "HTML file is empty")]


def test_rate_counts_by_window(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "md"), ("2024-01-01 00:00:50", "md"), ("2024-01-01 00:01:10", "md")], "t string, format string").select(F.to_timestamp("t").alias("modified"), "format")
    assert sorted(r["files"] for r in watch.rate(df).collect()) == [1, 2]
