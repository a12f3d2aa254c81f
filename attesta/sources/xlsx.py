"""The first sheet of an Excel workbook as rows of texts, read through Spark so that any store will do."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Built-in number formats of dates and times; fixed values.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(z: zipfile.ZipFile, name: str, tag: str) -> list[str]:
    if name not in z.namelist():
        return []
    return ["".join(t.text or "" for t in e.iter(f"{_MAIN}t")) for e in ElementTree.fromstring(z.read(name)).iter(f"{_MAIN}{tag}")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook lists first; without a list the one with the lowest number."""
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheet = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"), None)
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets.get(sheet.get(_LINK), "") if sheet is not None else ""
        part = target.removeprefix("/") if target.startswith("/") else f"xl/{target}"
        if part in names:
            return part
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def sheet_rows(file) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts that the type ladder of CSV files reads; blank ones too, but not at the end."""
    blank = 0
    for place, row in enumerate_rows(file):
        blank += place
        if any(x is not None for x in row):
            yield from ([] for _ in range(blank))
            yield row
            blank = 0
        else:
            blank += 1


def enumerate_rows(file) -> Iterator[tuple[int, list[str | None]]]:
    """(rows left out before, cells) of each row that the sheet has."""
    seen = 0
    with zipfile.ZipFile(file) as z:
        shared, dates = _texts(z, "xl/sharedStrings.xml", "si"), _date_styles(z)
        with z.open(_first_sheet(z)) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    v, kind = c.find(f"{_MAIN}v"), c.get("t", "n")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is None or v.text is None:
                        continue
                    elif kind == "s":
                        out[at] = shared[int(v.text)]
                    elif kind == "b":
                        out[at] = "true" if v.text == "1" else "false"
                    elif kind == "n" and int(c.get("s", 0)) in dates:
                        out[at] = (datetime(1899, 12, 30) + timedelta(days=float(v.text))).isoformat(" ", "microseconds")
                    elif kind == "n" and float(v.text).is_integer():
                        out[at] = str(int(float(v.text)))
                    else:
                        out[at] = v.text
                number = int(row.get("r") or seen + 1)
                yield number - seen - 1, out
                seen = number
                row.clear()


def _headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts = [next(sheet_rows(BytesIO(c.as_py())), []) for c in batch.column(0)]
        yield pa.record_batch([pa.array(firsts, pa.list_(pa.string()))], names=["header"])


def _rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0):
                rows = islice(sheet_rows(BytesIO(c.as_py())), 1, None)
                while some := list(islice(rows, 5000)):
                    cells = ([r[i] if i < len(r) else None for r in some] for i in range(width))
                    yield pa.record_batch([pa.array(x, pa.string()) for x in cells], names=[f"c{i}" for i in range(width)])

    return run


def read_sheet(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """(rows with columns c0, c1, ... of texts, header); no rows without a header."""
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.mapInArrow(_headers, "header array<string>").first().header
    header = ["" if x is None else x for x in first]
    if not header:
        return None, []
    return files.mapInArrow(_rows(len(header)), ", ".join(f"c{i} string" for i in range(len(header)))), header
