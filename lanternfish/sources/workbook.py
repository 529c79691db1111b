"""Half-year reports: xlsx workbooks with one TV and one film sheet.

The engine has no xlsx reader, so a workbook's bytes come through `binaryFile` and are
parsed on the executors with the standard library; a workbook is one record, so files
are the unit of parallelism. Everything after the cells is Catalyst.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.titles import parse_runtime

from .contracts import ContractError, expect_columns, require

# --- fixed values -----------------------------------------------------------------------
SHEET_KIND = {"TV": "tv", "Shows": "tv", "Film": "film", "Movies": "film"}
COLUMNS = ["Title", "Available Globally?", "Release Date", "Hours Viewed", "Runtime", "Views"]
HEADER_ROW = 6
FIRST_COLUMN = 2
CATCH_ALL = ("Other Shows", "Other Movies")
# -----------------------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
CELLS = "sheet string, kind string, n int, title string, available string, released string, hours string, runtime string, views string, numeric_hours boolean, numeric_views boolean"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def sheets(content: bytes) -> Iterator[tuple[str, Iterator[tuple[int, dict[int, tuple[str, bool]]]]]]:
    """(name, rows) of each sheet; a row is its number and {column: (text, is a number)}."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}

    def rows(path: str):
        for row in ElementTree.fromstring(book.read(path)).iter(f"{{{_NS['m']}}}row"):
            cells = {}
            for c in row:
                letters = re.match("[A-Z]+", c.get("r")).group()
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                kind, v = c.get("t", "n"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    cells[at] = (_text(c), False)
                elif v is not None and v.text is not None:
                    cells[at] = (shared[int(v.text)], False) if kind == "s" else (v.text, kind == "n")
            yield int(row.get("r")), cells

    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS):
        target = links[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
        yield s.get("name"), rows(target if target.startswith("xl/") else f"xl/{target}")


def read_cells(content: bytes, where: str) -> Iterator[tuple]:
    """All rows below the headers of both sheets, as text with a note of what was a number."""
    tables = {name: dict(rows) for name, rows in sheets(content)}
    kinds = sorted(SHEET_KIND.get(name, f"unknown sheet {name}") for name in tables)
    if kinds != sorted(set(SHEET_KIND.values())):
        raise ContractError(f"{where}: one sheet of each kind expected, found {kinds}")
    wanted = range(FIRST_COLUMN, FIRST_COLUMN + len(COLUMNS))
    for name, rows in tables.items():
        expect_columns([rows.get(HEADER_ROW, {}).get(c, (None,))[0] for c in wanted], COLUMNS, f"{where}/{name}")
        for n, cells in rows.items():
            if n > HEADER_ROW:
                text, number = zip(*(cells.get(c, (None, False)) for c in wanted), strict=True)
                yield name, SHEET_KIND[name], n, *text, number[COLUMNS.index("Hours Viewed")], number[COLUMNS.index("Views")]


def read_workbooks(spark: SparkSession, path: str, period: str, start, end) -> DataFrame:
    """One report's rows: typed, with catch-all rows flagged and their other fields null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(read_cells(content, name)), columns=names)

    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)
    # rows without a title and hours are blank; text after an asterisk, without hours, is a note
    note = F.startswith("title", F.lit("*")) & ~F.col("numeric_hours")
    cells = cells.where((F.col("title").isNotNull() | F.col("hours").isNotNull()) & ~F.coalesce(note, F.lit(False)))
    catch_all = F.col("title").isin(*CATCH_ALL)
    kept = {c: F.when(~catch_all, F.col(c)) for c in ("available", "released", "runtime", "views")}
    hours = require(F.col("hours"), F.col("numeric_hours"), "hours are not a number").cast("double").cast("long")
    available = require(kept["available"], kept["available"].isNull() | kept["available"].isin("Yes", "No"), "Available Globally? is neither Yes nor No")
    views = require(kept["views"], kept["views"].isNull() | F.col("numeric_views"), "views are not a number").cast("double").cast("long")
    # dates are ISO text, or days since the end of 1899
    serial = kept["released"].rlike(r"^\d+(\.\d+)?$")
    released = F.when(serial, F.date_add(F.lit("1899-12-30").cast("date"), F.floor(kept["released"].try_cast("double")).cast("int"))).otherwise(F.substring(kept["released"], 1, 10).try_cast("date"))
    r = parse_runtime(kept["runtime"])
    return cells.select(
        F.lit(period).alias("period"), F.lit(start).cast("date").alias("period_start"), F.lit(end).cast("date").alias("period_end"), "kind", "title",
        (available == "Yes").alias("available_globally"), released.alias("release_date"), hours.alias("hours_viewed"), r["hours"].alias("runtime_hours"), r["withheld"].alias("runtime_withheld"), r["starred"].alias("runtime_starred"),
        views.alias("views"), catch_all.alias("is_catch_all"), F.concat("sheet", F.lit("!"), F.col("n").cast("string")).alias("source_row"))
