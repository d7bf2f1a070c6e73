"""Command line: a file or a folder of documents to LaTeX, and to PDF where an engine is installed."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import markdown, render
from .operators.styles import STYLES
from .sources import files, sinks
from .streaming import watch

TEXTS = ("title", "subtitle", "author", "date", "status", "classification", "summary")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellumspark", description=__doc__, allow_abbrev=False)
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("-v", "--version", action="store_true")
    p.add_argument("--list-styles", action="store_true")
    p.add_argument("-s", "--style", default="")
    p.add_argument("-b", "--batch", nargs="+", metavar=("DIR", "OUT"))
    p.add_argument("-w", "--watch", action="store_true")
    p.add_argument("--toc", dest="toc", action="store_true", default=None)
    p.add_argument("--no-toc", dest="toc", action="store_false")
    p.add_argument("--no-title-page", action="store_true")
    p.add_argument("--no-signatures", action="store_true")
    p.add_argument("--tex", action="store_true")
    p.add_argument("-t", "--template", default="")
    p.add_argument("--language", "--lang", default="")
    p.add_argument("--font-size", type=int, choices=(10, 11, 12), default=0)
    for name in TEXTS:
        p.add_argument(f"--{name}", default="")
    return p


def options(args: argparse.Namespace) -> render.Options:
    template = Path(args.template).read_text(encoding="utf-8") if args.template else ""
    return render.Options(style=args.style, toc=args.toc, no_title_page=args.no_title_page, no_signatures=args.no_signatures, font_size=args.font_size, language=args.language, template=template, **{n: getattr(args, n) for n in TEXTS})


def local(path: Column) -> Column:
    """A path of this machine without its scheme."""
    return F.regexp_replace(path, "^file:/*", "/")


def convert(texts: DataFrame, opts: render.Options, generated: str) -> DataFrame:
    """(path, doc, latex) of canonical texts without errors; relative images lie in each document's own folder."""
    docs = markdown.documents(texts.where("error is null"))
    return render.rendered(docs, opts, generated, files.folder_of(local(F.col("path"))))


def save(texts: DataFrame, opts: render.Options, generated: str, name_of: Callable[[Path], Path], tex: bool) -> tuple[int, int]:
    """Write one document after another, as the caller asked for files on this machine; errors are told.  Returns (PDFs made, documents)."""
    made = failed = 0
    for r in texts.where("error is not null").select("path", "error").toLocalIterator():
        print(f"  {r['path'].removeprefix('file:')}: {r['error']}", file=sys.stderr)
        failed += 1
    done = 0
    for r in sinks.compiled(convert(texts, opts, generated)).toLocalIterator():
        source = Path(r["path"].removeprefix("file:"))
        name = name_of(source)
        name.parent.mkdir(parents=True, exist_ok=True)
        if tex or r["pdf"] is None:
            name.with_suffix(".tex").write_text(r["latex"], encoding="utf-8")
        if r["pdf"] is None:
            print(f"  {source}: {r['error']}", file=sys.stderr)
        else:
            name.write_bytes(bytes(r["pdf"]))
            made += 1
        done += 1
    return made, done + failed


def save_pictures(scanned: DataFrame) -> None:
    """Write the pictures of spreadsheets beside them, where their texts name them; one that is there already stays."""
    for r in files.media(scanned).toLocalIterator():
        at = Path(r["path"].removeprefix("file:")).parent / r["file"]
        if not at.exists():
            at.write_bytes(bytes(r["content"]))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.version:
        print(__version__)
        return 0
    if args.list_styles:
        print("\n".join(STYLES))
        return 0
    if not args.batch and not args.input:
        parser().print_help()
        return 1
    import datetime

    spark = SparkSession.builder.appName("vellumspark").getOrCreate()
    today = datetime.date.today().isoformat()
    where = Path(args.batch[0] if args.batch else args.input).resolve()
    if args.batch:
        out = Path(args.batch[1]) if len(args.batch) > 1 else where / "pdf"
        name_of = lambda source: (out / source.relative_to(where)).with_suffix(".pdf")
    else:
        name = Path(args.output) if args.output else where.with_suffix(".pdf")
        out, name_of = name.parent, lambda _: name
    opts = options(args)
    if args.watch and not args.batch:

        def handle(texts: DataFrame, _: int) -> None:
            save(texts.where(local(F.col("path")) == str(where)), opts, today, name_of, args.tex)

        watch.convert_stream(watch.watched(spark, str(where.parent), batch=False), handle, str(out / ".watch")).start().awaitTermination()
        return 0
    scanned = files.scan(spark, str(where), batch=bool(args.batch))
    save_pictures(scanned)
    made, of = save(files.canonical(scanned).persist(), opts, today, name_of, args.tex)
    print(f"Done: {made}/{of} PDFs in {out}")
    return 0 if args.batch or made == of else 1


if __name__ == "__main__":
    sys.exit(main())
