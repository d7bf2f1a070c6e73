import pytest

from vellumspark import cli
from vellumspark.operators import markdown, render
from vellumspark.sources import files, sinks


def test_flags():
    a = cli.parser().parse_args(["x.md", "y.pdf", "--style", "memo", "--no-toc", "--font-size", "12", "--lang", "lv", "--status", "final", "--no-signatures"])
    o = cli.options(a)
    assert (a.input, a.output, o.style, o.toc, o.font_size, o.language, o.status, o.no_signatures) == ("x.md", "y.pdf", "memo", False, 12, "lv", "final", True)
    for bad in (["--font-size", "13"], ["--nope"], ["a", "b", "c"], ["--style"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_version_and_styles(capsys):
    assert cli.main(["--version"]) == 0 and cli.main(["--list-styles"]) == 0
    assert "legal" in capsys.readouterr().out


def test_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\ntext")
    done = render.rendered(markdown.documents(files.canonical(files.scan(spark, str(tmp_path))).where("error is null")))
    sinks.write_latex(done, str(tmp_path / "out"))
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row["style"] == "report" and row["tex_path"].endswith("/a.tex")
    (pdf,) = sinks.compiled(done).collect()
    assert pdf["pdf_path"].endswith("/a.pdf") and (pdf["pdf"] is None) == (pdf["error"] is not None)
    assert sinks.summarise("a\n! b\nc Missing d") == "! b\nc Missing d"


def test_single_files_batches_and_errors(spark, tmp_path, capsys, monkeypatch):
    seen = []

    def compile_in_place(rendered):
        seen.append(1)
        return rendered.selectExpr("path", "latex", "case when latex like '%fails%' then null else cast('PDF' as binary) end as pdf", "case when latex like '%fails%' then 'no luck' end as error")

    monkeypatch.setattr(sinks, "compiled", compile_in_place)
    monkeypatch.setattr(spark, "stop", lambda: None)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "x.md").write_text("# T\n![p](img/i.png)")
    (tmp_path / "in" / "sub" / "bad.md").write_text("# T\nfails")
    (tmp_path / "in" / "old.xls").write_bytes(b"x")
    (tmp_path / "in" / "empty.csv").write_text(" ")
    (tmp_path / "in" / "README.md").write_text("# R")
    assert cli.main([str(tmp_path / "in" / "x.md"), str(tmp_path / "out" / "y.pdf"), "--tex"]) == 0 and seen == [1]
    assert (tmp_path / "out" / "y.pdf").read_bytes() == b"PDF" and f"{{{tmp_path}/in/img/i.png}}" in (tmp_path / "out" / "y.tex").read_text()
    assert cli.main([str(tmp_path / "in" / "README.md")]) == 0 and (tmp_path / "in" / "README.pdf").exists()
    capsys.readouterr()
    assert cli.main([str(tmp_path / "in" / "old.xls")]) == 1 and "not supported" in capsys.readouterr().err
    assert cli.main([str(tmp_path / "in" / "sub" / "bad.md")]) == 1 and "no luck" in capsys.readouterr().err
    assert cli.main(["--batch", str(tmp_path / "in"), str(tmp_path / "all")]) == 0
    told = capsys.readouterr()
    assert "CSV file is empty" in told.err and "no luck" in told.err and "Done: 1/3" in told.out
    assert (tmp_path / "all" / "x.pdf").exists() and not (tmp_path / "all" / "README.pdf").exists()
