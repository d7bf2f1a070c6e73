"""Spreadsheet files: ZIP parts by name, XML by local names, to a struct that column functions turn into text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".bmp")
#: Points read of a chart's series.
POINTS = 20
SCHEMA = "struct<sheets:array<struct<name:string,rows:array<array<string>>>>,charts:array<struct<title:string,kind:string,series:array<struct<name:string,categories:array<string>,values:array<string>>>>>,media:array<struct<name:string,file:string,content:binary>>,error:string>"
REF = re.compile(r"([A-Z]*)(.*)", re.S)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def kids(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [x for x in node if local(x.tag) == name]


def kid(node: ET.Element | None, name: str) -> ET.Element | None:
    found = kids(node, name)
    return found[-1] if found else None


def text_of(node: ET.Element | None) -> str:
    return "" if node is None else node.text or ""


def attribute(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if local(k) == name), "")


def rich(node: ET.Element | None) -> str:
    """Its own text, else that of its runs."""
    return text_of(kid(node, "t")) or "".join(text_of(kid(r, "t")) for r in kids(node, "r"))


def number(s: str) -> int | None:
    return int(s) if re.fullmatch(r"[+-]?[0-9]+", s) else None


class Book:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = self.zip.namelist()

    def part(self, name: str) -> bytes | None:
        real = next((n for n in self.names if n.lower() == name.lower()), None)
        return None if real is None else self.zip.read(real)

    def shared(self) -> list[str]:
        data = self.part("xl/sharedStrings.xml")
        return [] if data is None else [rich(si) for si in kids(ET.fromstring(data), "si")]

    def targets(self) -> dict[str, str]:
        data = self.part("xl/_rels/workbook.xml.rels")
        try:
            rels = [] if data is None else kids(ET.fromstring(data), "Relationship")
        except ET.ParseError:
            rels = []
        return {attribute(r, "Id"): attribute(r, "Target") for r in rels if "worksheet" in attribute(r, "Type")}

    def sheets(self) -> Iterator[tuple[str, list[list[str]]]]:
        shared = self.shared()
        data = self.part("xl/workbook.xml")
        if data is None:
            raise ValueError("failed to read workbook")
        targets = self.targets()
        for i, sheet in enumerate(kids(kid(ET.fromstring(data), "sheets"), "sheet"), 1):
            rid = next((v for k, v in sheet.attrib.items() if local(k) == "id"), "")
            xml = self.part("xl/" + targets[rid] if rid in targets else f"xl/worksheets/sheet{i}.xml")
            try:
                rows = [] if xml is None else grid(ET.fromstring(xml), shared)
            except ET.ParseError:
                continue
            if rows:
                yield attribute(sheet, "name"), rows


def cell_text(c: ET.Element, shared: list[str]) -> str:
    kind, value = attribute(c, "t"), text_of(kid(c, "v"))
    if kind == "s":
        i = number(value)
        return shared[i] if i is not None and 0 <= i < len(shared) else value
    if kind == "inlineStr":
        return rich(kid(c, "is"))
    if kind == "b":
        return "Yes" if value == "1" else "No"
    return value


def grid(sheet: ET.Element, shared: list[str]) -> list[list[str]]:
    """Dense rows without the empty ones; cells without a column are not shown."""
    cells: dict[tuple[int, int], str] = {}
    for row in kids(kid(sheet, "sheetData"), "row"):
        for c in kids(row, "c"):
            letters, digits = REF.match(attribute(c, "r")).groups()  # type: ignore[union-attr]
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            at = number(digits) or number(attribute(row, "r")) or 0
            if value := cell_text(c, shared):
                cells[at, col] = value
    width = max((c for _, c in cells), default=0)
    numbers = sorted({r for r, c in cells if r >= 1 and c >= 1})
    return [[cells.get((r, c), "") for c in range(1, width + 1)] for r in numbers] if width and max(r for r, _ in cells) else []


def between(s: str, a: str, b: str) -> str | None:
    start = s.find(a)
    end = s.find(b, start) if start >= 0 else -1
    return None if end < 0 else s[start + len(a) : end]


def points(block: str, tag: str, most: int) -> list[str]:
    """Cached values by index; values without a point fill the first empty place."""
    out = [""] * most
    start = block.find(f"<{tag}>")
    start = block.find(f"<{tag}") if start < 0 else start
    end = block.find(f"</{tag}>", start) if start >= 0 else -1
    if end < 0:
        return out
    rest = block[start:end]
    for m in re.finditer(r'<c:pt (?:(?!<c:v>).)*?idx="([^"]*)"(?:(?!<c:v>).)*<c:v>(.*?)</c:v>', rest, re.S):
        i = number(m[1])
        if i is not None and 0 <= i < most:
            out[i] = m[2]
    tail = rest[rest.rfind("<c:pt ") :] if "<c:pt " in rest else rest
    loose = re.findall(r"<c:v>(.*?)</c:v>", tail, re.S)[1 if "<c:pt " in rest else 0 :]
    for value in loose:
        if "" in out:
            out[out.index("")] = value
    return out


def chart(xml: str) -> dict | None:
    from ..operators.grid import CHARTS

    block = between(xml, "<c:title>", "</c:title>") or ""
    title = between(block, "<a:t>", "</a:t>") or between(block, "<c:v>", "</c:v>") or ""
    series = []
    for ser in re.findall(r"<c:ser>(.*?)</c:ser>", xml, re.S):
        one = {"name": points(ser, "c:tx", 1)[0], "categories": [x for x in points(ser, "c:cat", POINTS) if x], "values": [x for x in points(ser, "c:val", POINTS) if x]}
        if any(one.values()):
            series.append(one)
    kind = next((name for tag, name in CHARTS if tag in xml), "")
    return {"title": title or "Chart", "kind": kind, "series": series} if title or series else None


def read_book(data: bytes) -> dict:
    try:
        book = Book(data)
        sheets = [{"name": n, "rows": r} for n, r in book.sheets()]
        charts = [c for n in book.names if n.startswith("xl/charts/chart") and n.endswith(".xml") if (c := chart(book.zip.read(n).decode("utf-8", "replace")))]
        media = [{"name": n.rpartition("/")[2].rpartition(".")[0], "file": n.rpartition("/")[2], "content": book.zip.read(n)} for n in book.names if n.startswith("xl/media/") and n.lower().endswith(PICTURES)]
    except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError) as e:
        return {"sheets": [], "charts": [], "media": [], "error": f"{type(e).__name__}: {e}"}
    return {"sheets": sheets, "charts": charts, "media": media, "error": None if sheets or charts else "XLSX file has no readable data"}


def workbook(content: Column) -> Column:
    """The parts of a spreadsheet file; pictures are binary values and are never written by workers."""

    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([read_book(bytes(x)) if x is not None else {"sheets": [], "charts": [], "media": [], "error": "no content"} for x in s], columns=["sheets", "charts", "media", "error"])

    read.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(read, SCHEMA)(content)


def workbook_markdown(book: Column, path: Column, input_dir: Column) -> Column:
    """Canonical text: a section a sheet, then charts, then pictures."""
    from ..functions.text import title_from_filename
    from ..operators.grid import chart_table, sheet_markdown

    sheet = lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n\n"), sheet_markdown(s["rows"]))
    kind = lambda c: F.when(c["kind"] != "", F.concat(F.lit("*Chart type: "), c["kind"], F.lit("*\n\n"))).otherwise("")
    one = lambda c: F.concat(F.lit("## "), c["title"], F.lit("\n\n"), kind(c), F.when(F.size(c["series"]) > 0, chart_table(c["series"])).otherwise(""))
    picture = lambda m: F.concat(F.lit("!["), m["name"], F.lit("]("), input_dir, F.lit("/"), m["file"], F.lit(")\n\n"))
    joined = lambda a, f: F.array_join(F.transform(a, f), "")
    head = F.concat(F.lit("---\ntitle: "), title_from_filename(path), F.lit("\nstyle: report\n---\n\n"))
    return F.when(book["error"].isNull(), F.concat(head, joined(book["sheets"], sheet), joined(book["charts"], one), joined(book["media"], picture)))
