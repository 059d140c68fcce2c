"""Inspection workbooks as a table of cells: zip and XML from the standard library, read where the files are."""

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
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet_ord int, sheet string, row_no int, col int, value string, vtype string"


def _column(ref: str) -> int:
    out = 0
    for letter in re.match(r"[A-Z]+", ref)[0]:
        out = out * 26 + ord(letter) - 64
    return out


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def workbook_cells(raw: bytes) -> Iterator[tuple[int, str, int, int, str, str]]:
    """(sheet_ord, sheet, row, column, value, type) of all cells with a value; formulas by their stored result."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
        for order, sheet in enumerate(sheets):
            target = targets[sheet.get(RELATION)]
            root = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for cell in root.iter(f"{MAIN}c"):
                ref, kind, value = cell.get("r"), cell.get("t", "n"), cell.find(f"{MAIN}v")
                row, col = int(re.search(r"\d+", ref)[0]), _column(ref)
                if kind == "inlineStr":
                    yield order, sheet.get("name"), row, col, _text(cell), "s"
                elif value is not None and value.text is not None:
                    yield order, sheet.get("name"), row, col, shared[int(value.text)] if kind == "s" else value.text, {"s": "s", "str": "s", "b": "b"}.get(kind, "n")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks at ``path``, one task per group of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sheet_ord", "sheet", "row_no", "col", "value", "vtype"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(file, *c) for c in workbook_cells(raw)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def form3_cells(spark: SparkSession, path: str) -> DataFrame:
    """The same with the file name, without its ending, as drawing."""
    return read_cells(spark, path).withColumn("drawing_id", F.regexp_extract("path", r"([^/]+)\.xlsx$", 1)).drop("path")


def write_workbook(sheets: dict[str, dict[tuple[int, int], object]]) -> bytes:
    """A minimal workbook of inline cells, for tests and exports."""

    def name(col: int) -> str:
        out = ""
        while col:
            col, rest = divmod(col - 1, 26)
            out = chr(65 + rest) + out
        return out

    def cell(row: int, col: int, value: object) -> str:
        ref = f"{name(col)}{row}"
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        text = str(value).replace("&", "&amp;").replace("<", "&lt;")
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    out, ns = io.BytesIO(), MAIN.strip("{}")
    with zipfile.ZipFile(out, "w") as book:
        listed = "".join(f'<sheet name="{s}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{RELATION[1:-3]}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, cells in enumerate(sheets.values(), 1):
            rows: dict[int, list[str]] = {}
            for (r, c), value in sorted(cells.items()):
                rows.setdefault(r, []).append(cell(r, c, value))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join(f'<row r="{r}">{"".join(v)}</row>' for r, v in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()
