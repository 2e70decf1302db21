"""Readers: delimited text with a sniffed layout, watch lists in JSON lines, workbooks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.sources.delimited import DELIMITERS, date_form, plain_number, split_line

SNIFF_LINES = 15


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter with the highest count over the first ten lines; a comma if there is none."""
    counts = {d: sum(x.count(d) for x in lines[:10]) for d in ",\t;|"}
    best = max(counts, key=lambda d: counts[d])
    return best if counts[best] else ","


def header_row(grid: list[list[str | None]]) -> int:
    """Index of the row among the first 15 that looks most like a header: filled, textual (double weight),
    distinct, and as wide as the widest (double weight); the first of equals."""
    rows = [[c.strip() for c in r if c and c.strip()] for r in grid[:SNIFF_LINES]]
    widest = max([1, *map(len, rows)])

    def score(k: int) -> float:
        full, width = rows[k], max(1, len(grid[k]))
        if not full:
            return float("-inf")
        data = sum(plain_number(c) is not None or date_form(c) is not None for c in full)
        return len(full) / width + 2 * (1 - data / len(full)) + len({c.lower() for c in full}) / len(full) + 2 * len(full) / widest

    return max(range(len(rows)), key=lambda k: (score(k), -k)) if rows else 0


def read_delimited(spark: SparkSession, path: str, header: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """All-string columns of a delimited file; the layout is sniffed on its first lines, rows are read in parallel.

    header, start and end are line numbers from 1, clamped to the file; blank lines are left out; empty cells are null."""
    lines = spark.read.text(path).limit(SNIFF_LINES)  # only the head comes to the driver
    head = [(r[0] or "").removeprefix("﻿") for r in lines.collect()]
    d = sniff_delimiter(head)
    grid = [[c.strip() or None for c in split_line(x, d)[0]] for x in head]
    at = min(max(header - 1, 0), max(len(grid) - 1, 0)) if header else header_row(grid)
    names = [c or f"column_{i + 1}" for i, c in enumerate(grid[at])] if grid else []
    rdd = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0][0]))  # line numbers need the order of the file
    raw = spark.createDataFrame(rdd, "line long, value string").where(f"line > {at + 1} and trim(value) <> ''")
    if start:
        raw = raw.where(F.col("line") >= max(start, at + 2))
    if end:
        raw = raw.where(F.col("line") <= end)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    x = raw.select("line", F.from_csv("value", schema, {"sep": d, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return x.select("line", *[F.nullif(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


WATCHLIST_SCHEMA = "id string, schema string, caption string, names array<string>, aliases array<string>, country string, programs array<string>, birthDate string"


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Entries in JSON lines: blank and malformed lines are dropped, missing lists are empty, missing texts ''."""
    d = spark.read.schema(WATCHLIST_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    blank, none = F.lit(""), F.array().cast("array<string>")
    return d.where("id is not null or caption is not null").select(
        *[F.coalesce(c, blank).alias(c) for c in ("id", "schema", "caption")], F.coalesce("names", none).alias("names"), F.coalesce("aliases", none).alias("aliases"),
        F.coalesce("country", blank).alias("country"), F.coalesce("programs", none).alias("programs"), "birthDate",
    )


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def workbook_sheets(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS)]


def read_workbook(path: str, sheet: int = 0) -> list[list[str | None]]:
    """The cells of a sheet of an .xlsx file as texts, blank rows kept; older .xls files are not supported."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{sheet + 1}.xml"))
    grid: list[list[str | None]] = []
    for row in root.iterfind(".//m:row", _NS):
        while len(grid) < int(row.get("r", len(grid) + 1)) - 1:
            grid.append([])
        cells: list[str | None] = []
        for c in row.iterfind("m:c", _NS):
            letters = re.match("[A-Z]*", c.get("r", "")).group()
            col = 0
            for ch in letters:
                col = col * 26 + ord(ch) - 64
            while letters and len(cells) < col - 1:
                cells.append(None)
            v = c.find("m:v", _NS)
            if c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
            else:
                text = None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            cells.append(text or None)
        grid.append(cells)
    return grid


__all__ = ["DELIMITERS", "header_row", "read_delimited", "read_watchlist", "read_workbook", "sniff_delimiter", "workbook_sheets"]
