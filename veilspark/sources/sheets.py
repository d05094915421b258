"""Spreadsheets (the XML form in a zip file) as a source: each file is parsed by one task, cells come as text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The rows of one sheet; shared and inline texts, numbers and booleans as text, empty cells null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for i, c in enumerate(row.iter(f"{_NS}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.findtext(f"{_NS}v"), c.get("t")
                    if kind == "s" and value is not None:
                        cells[at] = shared[int(value)]
                    elif kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    else:
                        cells[at] = value if kind != "b" or value is None else str(value == "1").lower()
                yield cells
                row.clear()


def read_sheets(spark: SparkSession, path: str, columns: list[str], sheet: int = 1) -> DataFrame:
    """(columns..., file) of all files of a path; the first row names the columns, those a file lacks are null."""
    schema = ", ".join([*[f"`{c}` string" for c in columns], "file string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                rows = sheet_rows(data, sheet)
                head = next(rows, [])
                at = [head.index(c) if c in head else None for c in columns]
                got = [[r[i] if i is not None and i < len(r) else None for i in at] for r in rows]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in got], pa.string()) for k, c in enumerate(columns)} | {"file": pa.array([name] * len(got), pa.string())})

    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content")).mapInArrow(run, schema)


def write_sheet(rows: list[list[object]]) -> bytes:
    """A small sheet as bytes, for exports of reports that are a few thousand rows."""
    from xml.sax.saxutils import escape

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    space = _NS.strip("{}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{space}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
