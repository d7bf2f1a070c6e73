"""Where rendered documents go: tables and text through Spark, and PDF through an external engine where a machine has one."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import output_path
from ..operators.markdown import passes
from ..shipping import ship

#: Engines in the order in which they are tried.
ENGINES = ("lualatex", "xelatex")
FLAGS = ("-interaction=nonstopmode", "-halt-on-error")


def write_latex(rendered: DataFrame, folder: str) -> None:
    """(path, style, tex_path, latex) as Parquet, a folder a style."""
    rendered.select("path", F.col("doc.style").alias("style"), output_path(F.col("path"), ".tex").alias("tex_path"), "latex").write.partitionBy("style").mode("errorifexists").parquet(folder)


def summarise(log: str) -> str:
    """Up to five lines of a log that look like errors, else its last ten."""
    lines = log.split("\n")
    marks = ("Error", "Undefined control sequence", "Missing")
    return "\n".join([x for x in lines if x.startswith("!") or any(m in x for m in marks)][:5] or lines[-10:])


def compile_one(latex: str, times: int) -> tuple[bytes | None, str | None]:
    """(PDF, None) or (None, error): the first engine that gets through all passes."""
    log = ""
    for engine in filter(shutil.which, ENGINES):
        with tempfile.TemporaryDirectory() as work:
            Path(work, "document.tex").write_text(latex, encoding="utf-8")
            for _ in range(max(1, times)):
                run = subprocess.run([engine, *FLAGS, "document.tex"], cwd=work, capture_output=True, check=False)
                if run.returncode:
                    log = (run.stdout + run.stderr).decode("utf-8", "replace")
                    break
            else:
                return Path(work, "document.pdf").read_bytes(), None
    return None, f"LaTeX compilation failed:\n{summarise(log)}" if log else "no LaTeX engine found"


def compiled(rendered: DataFrame) -> DataFrame:
    """(path, pdf_path, latex, pdf binary, error): documents are compiled where they are, and each worker's files stay in its own temporary folder."""
    ship(rendered.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [compile_one(t, int(n)) for t, n in zip(b["latex"], b["passes"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "pdf_path": b["pdf_path"], "latex": b["latex"], "pdf": [x for x, _ in done], "error": [e for _, e in done]})

    rows = rendered.select("path", output_path(F.col("path")).alias("pdf_path"), "latex", passes(F.col("doc")).alias("passes"))
    return rows.mapInPandas(run, "path string, pdf_path string, latex string, pdf binary, error string")
