"""Byte offsets, lines, columns and UTF-16 positions of texts."""

from __future__ import annotations

import pandas as pd

from glossa.functions.udf import arrow


def line_column(text: str, offset: int) -> tuple[int, int]:
    """Line (from 1) and column in characters (from 0) of a byte offset."""
    before = text.encode()[:offset].decode("utf-8", "ignore")
    line = before.count("\n")
    return line + 1, len(before) - (before.rfind("\n") + 1)


def utf16_offset(text: str, line: int, column: int) -> int | None:
    """The byte offset of an editor position (line from 0, column in UTF-16 units); None outside the text or inside a character."""
    lines = text.split("\n")
    if not 0 <= line < len(lines) or column < 0:
        return None
    at, units = 0, 0
    for c in lines[line]:
        if units >= column:
            break
        units += 2 if ord(c) > 0xFFFF else 1
        at += len(c.encode())
    if units != column:
        return None
    return sum(len(x.encode()) + 1 for x in lines[:line]) + at


def apply_edits(text: str, edits: list[dict]) -> str | None:
    """Edits in order: each replaces a range (start_line, start_column, end_line, end_column), or all if it has none.

    A range outside the text makes the whole update void.
    """
    for e in edits:
        if e.get("start_line") is None:
            text = e["text"]
            continue
        start, end = utf16_offset(text, e["start_line"], e["start_column"]), utf16_offset(text, e["end_line"], e["end_column"])
        if start is None or end is None or start > end:
            return None
        data = text.encode()
        text = (data[:start] + e["text"].encode() + data[end:]).decode()
    return text


@arrow("struct<line:int,column:int>")
def line_columns(text: pd.Series, offset: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_column(t, int(o)) for t, o in zip(text, offset)], columns=["line", "column"])


@arrow("long")
def utf16_offsets(text: pd.Series, line: pd.Series, column: pd.Series) -> pd.Series:
    return pd.Series([utf16_offset(t, int(a), int(b)) for t, a, b in zip(text, line, column)], dtype="Int64")
