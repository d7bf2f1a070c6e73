"""Delimited text with lazy quotes, ragged rows and a sniffed delimiter: a state machine over characters, so Python in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import csv_delimiter


def records(text: str, comma: str) -> list[list[str]]:
    """Rows of fields.  Blank lines are skipped; white space before a field goes; a quote inside an unquoted field, or one that no delimiter
    follows, is a plain character; an open quote runs to the end."""
    text = text.replace("\r\n", "\n")
    blank = re.compile(r"[^\S\n]*")
    rows: list[list[str]] = []
    at, n = 0, len(text)
    while at < n:
        if text[at] == "\n":
            at += 1
            continue
        row: list[str] = []
        while True:
            at = blank.match(text, at).end()  # type: ignore[union-attr]
            if at < n and text[at] == '"':
                field, at = quoted(text, at + 1, comma)
            else:
                end = at
                while end < n and text[end] not in (comma, "\n"):
                    end += 1
                field, at = text[at:end], end
            row.append(field)
            if at < n and text[at] == comma:
                at += 1
                continue
            at += 1
            break
        rows.append(row)
    return rows


def quoted(text: str, at: int, comma: str) -> tuple[str, int]:
    """(field, place behind it) of a field whose opening quote stands before ``at``."""
    out = []
    while True:
        end = text.find('"', at)
        if end < 0:
            rest = text[at:]
            out.append(rest[:-1] if rest.endswith("\n") else rest)
            return "".join(out), len(text)
        out.append(text[at:end])
        after = text[end + 1 : end + 2]
        if after == '"':
            out.append('"')
            at = end + 2
        elif after in (comma, "\n", ""):
            return "".join(out), end + 1
        else:
            out.append('"')
            at = end + 1


def csv_rows(content: Column) -> Column:
    """array<array<string>> of a file's text, by its own delimiter."""

    def split(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, comma in parts:
            yield pd.Series([None if t is None else records(t, c) for t, c in zip(text, comma, strict=True)])

    split.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(split, "array<array<string>>")(content, csv_delimiter(content))
