"""``.xlsx`` workbooks as DataFrames.

Each workbook is one ``binaryFile`` row; ``mapInPandas`` parses it in the task
that holds it (standard-library zip + XML, no extra dependency) and emits its
first worksheet as ``path, row_no, cells array<string>``. The header rule then
runs as column expressions, like for CSV files.
"""

from __future__ import annotations

import io
import pickle
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timedelta
from itertools import chain, islice
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.files import generic_names, headers_look_like_data

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
ROWS_SCHEMA = "path string, row_no long, cells array<string>"


# Spreadsheet day 0 (1900 system, with its leap-year quirk folded in) and the 1904 system.
_EPOCH_1900 = datetime(1899, 12, 30)
_EPOCH_1904 = datetime(1904, 1, 1)
# Built-in number formats that are dates or times.
_BUILTIN_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}


def _date_styles(styles_xml: bytes) -> set[int]:
    """Indexes of cell styles whose number format shows a date or time."""
    root = ET.fromstring(styles_xml)
    custom = {}
    fmts = root.find("m:numFmts", _NS)
    for f in (fmts if fmts is not None else []):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower()
        custom[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code))
    out = set()
    xfs = root.find("m:cellXfs", _NS)
    for i, xf in enumerate(xfs if xfs is not None else []):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _BUILTIN_DATE_FORMATS or custom.get(fid, False):
            out.add(i)
    return out


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _fmt_number(text: str) -> str:
    """Numbers as a spreadsheet library would hand them over (int when integral)."""
    try:
        v = float(text)
    except ValueError:
        return text
    return str(int(v)) if v.is_integer() and "." not in text and "e" not in text.lower() else str(v)


def parse_first_sheet(data: bytes, max_rows: int | None = None) -> list[list[str]]:
    """Rows of the first worksheet, cells as display strings ('' when empty);
    ``max_rows`` stops early (header probes read one row)."""
    return list(islice(first_sheet_rows(data), max_rows))


def first_sheet_rows(data: bytes) -> Iterator[list[str]]:
    """The rows of ``parse_first_sheet`` one by one; none is kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        date_styles = _date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        pr = wb.find("m:workbookPr", _NS)
        epoch = _EPOCH_1904 if pr is not None and pr.get("date1904") in ("1", "true") else _EPOCH_1900
        sheets = wb.find("m:sheets", _NS)
        if sheets is None or not len(sheets):
            return
        rid = sheets[0].get(f"{{{_NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("pr:Relationship", _NS) if r.get("Id") == rid)
        target = target.lstrip("/")
        sheet_path = target if target.startswith("xl/") else "xl/" + target
        data_tag, row_tag, c_tag = (f"{{{_NS['m']}}}{tag}" for tag in ("sheetData", "row", "c"))
        parent = None
        with z.open(sheet_path) as fh:
            for event, el in ET.iterparse(fh, events=("start", "end")):
                if event == "start":
                    parent = el if el.tag == data_tag else parent
                    continue
                if el.tag != row_tag:
                    continue
                cells: dict[int, str] = {}
                for c in el.iter(c_tag):
                    idx = _col_index(c.get("r")) if c.get("r") else len(cells)
                    cells[idx] = _cell_text(c, shared, date_styles, epoch)
                width = max(cells) + 1 if cells else 0
                yield [cells.get(i, "") for i in range(width)]
                # the sheet holds no row that is done, not even an empty one
                (el if parent is None else parent).clear()


def _cell_text(c, shared: list[str], date_styles: set[int] = frozenset(), epoch=None) -> str:
    t = c.get("t")
    v = c.find("m:v", _NS)
    style = c.get("s")
    if t in (None, "n") and v is not None and style is not None and int(style) in date_styles:
        try:
            ms = round(float(v.text) * 86_400_000)
            return str((epoch or _EPOCH_1900) + timedelta(milliseconds=ms))
        except (TypeError, ValueError, OverflowError):
            pass
    if t == "inlineStr":
        is_el = c.find("m:is", _NS)
        return "".join(x.text or "" for x in is_el.iter(f"{{{_NS['m']}}}t")) if is_el is not None else ""
    if v is None:
        return ""
    if t == "s":
        return shared[int(v.text)]
    if t == "b":
        return "True" if v.text == "1" else "False"
    if t in ("str", "e"):
        return v.text or ""
    return _fmt_number(v.text or "")


#: Rows of a sheet that are held and handed on at once.
SHEET_BATCH = 2000


def _parser(max_rows: int | None):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                # rows wait on disk until the sheet's end: a damaged workbook has none
                with tempfile.TemporaryFile() as spool:
                    parts = 0
                    try:
                        rows = islice(first_sheet_rows(bytes(content)), max_rows)
                        while part := list(islice(rows, SHEET_BATCH)):
                            pickle.dump(part, spool)
                            parts += 1
                    except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration):
                        continue
                    spool.seek(0)
                    for k in range(parts):
                        part = pickle.load(spool)
                        yield pd.DataFrame({"path": path, "row_no": range(k * SHEET_BATCH, k * SHEET_BATCH + len(part)),
                                            "cells": part})
    return parse


def workbook_rows(spark: SparkSession, paths: str | Sequence[str], max_rows: int | None = None) -> DataFrame:
    """``path, row_no, cells`` for the first sheet of every ``.xlsx`` file."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", "true").load(paths if isinstance(paths, str) else list(paths)))
    return files.select("path", "content").mapInPandas(_parser(max_rows), ROWS_SCHEMA)


def read_workbooks(spark: SparkSession, paths: str | Sequence[str], width: int | None = None) -> DataFrame:
    """Workbooks as a string table keyed by ``source_file``: a first row that
    looks like data makes the sheet headerless (``Column N`` names); otherwise the
    first row of the first workbook names the columns (blank → ``Column i``)."""
    heads = workbook_rows(spark, paths, max_rows=1).select("path", F.col("cells").alias("head"))
    heads = heads.withColumn("has_header", ~headers_look_like_data(F.col("head"))).persist()
    rows = workbook_rows(spark, paths).join(heads.select("path", "has_header"), "path")
    has_header = F.col("has_header")
    n = width or heads.select(F.max(F.size("head"))).first()[0] or 0
    head = heads.first()
    names = generic_names(n)
    if head is not None and head.has_header:
        names = [(head.head[i].strip() if i < len(head.head) and head.head[i].strip() else f"Column {i + 1}")
                 for i in range(n)]
    body = rows.where(~(has_header & (F.col("row_no") == 0)))
    return body.select(F.col("path").alias("source_file"),
                       *[F.element_at("cells", i + 1).alias(name) for i, name in enumerate(names)])


def xlsx_bytes(header: list[str], rows: Iterable[list[object]]) -> bytes:
    """A workbook of ``write_xlsx`` in memory."""
    buf = io.BytesIO()
    write_xlsx(buf, header, rows)
    return buf.getvalue()


def write_xlsx(out, header: list[str], rows: Iterable[list[object]]) -> None:
    """A minimal single-sheet workbook (inline strings, numbers) — used to stage files.
    Rows are written as they come; none is kept."""
    def cell(ref: str, v: object) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        text = str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'

    def col(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, rem = divmod(i - 1, 26)
            s = chr(65 + rem) + s
        return s

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                   '</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="' + _NS["pr"] + '">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="' + _NS["m"] + '" xmlns:r="' + _NS["r"] + '">'
                   '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="' + _NS["pr"] + '">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="' + _NS["m"] + '"><sheetData>').encode())
            for r_i, row in enumerate(chain([header], rows), start=1):
                text = f'<row r="{r_i}">' + "".join(cell(f"{col(c)}{r_i}", v) for c, v in enumerate(row)) + "</row>"
                sheet.write(text.encode())
            sheet.write(b"</sheetData></worksheet>")
