"""Sheets of Excel files, read through Spark's file systems and parsed by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cells of a sheet (by name, else the first) as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().iter(f"{MAIN}si")]
        sheets = {s.get("name"): s.get(LINK) for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(map(str, sheets))}")
        link = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        target = next(r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot() if r.get("Id") == link)
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for _, row in ElementTree.iterparse(z.open(name)):
            if row.tag != f"{MAIN}row":
                continue
            out: list[str | None] = []
            for i, cell in enumerate(row.iter(f"{MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else i
                out += [None] * (at + 1 - len(out))
                v = cell.find(f"{MAIN}v")
                if cell.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif v is not None and v.text is not None:
                    out[at] = shared[int(v.text)] if cell.get("t") == "s" else v.text
            row.clear()
            yield out


def _name(cell: str | None, i: int) -> str:
    return f"column_{i}" if cell is None else cell[:-2] if re.fullmatch(r"\d+\.0", cell) else cell


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet as text columns, named by its first row.  One file is one task; its sheet's rows are made one by one."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def head(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([next(rows(x, sheet))], pa.list_(pa.string()))], names=["cells"])

    names = [_name(c, i) for i, c in enumerate(files.mapInArrow(head, "cells array<string>").first()["cells"])]

    def body(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                cells = rows(x, sheet)
                next(cells)
                while part := [(r + [None] * len(names))[: len(names)] for r, _ in zip(cells, range(1000), strict=False)]:
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], names=["cells"])

    cells = files.mapInArrow(body, "cells array<string>")
    return cells.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
