"""Spreadsheet workbooks: zipped XML, read where the files are, one file a task at a time, and written as bytes.

A sheet's rows are read as a stream, so memory holds the file's bytes, its shared strings and one batch of rows.
Cells are text as the file has it; numbers are coerced later, as for delimited files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch.
BATCH = 4096
ROWS = "path string, row long, cells array<string>"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    """The text of a string element: of its runs, not of phonetic hints."""
    return "".join(t.text or "" for part in e if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else [x for x in part if _tag(x) == "t"]))


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(content: bytes) -> dict[str, str]:
    """Sheets of a workbook in order, with the parts of the archive that hold them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    out = {}
    for s in book.iter():
        if _tag(s) == "sheet":
            target = links[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of a sheet, the first where none is named; cells that are left out are null."""
    names = sheet_names(content)
    if sheet is not None and sheet not in names:
        raise ValueError(f"no sheet {sheet} among {sorted(names)}")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if _tag(e) == "si":
                    shared.append(_text(e))
                    e.clear()
        last = 0
        for _, e in ElementTree.iterparse(z.open(names[sheet] if sheet is not None else next(iter(names.values())))):
            if _tag(e) != "row":
                continue
            last, cells = int(e.get("r") or last + 1), []
            for c in e:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, parts = c.get("t"), {_tag(p): p for p in c}
                value = _text(parts["is"]) if "is" in parts else parts["v"].text if "v" in parts else None
                if value is not None and kind == "s":
                    value = shared[int(value)]
                cells[at] = {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else None if kind == "e" else value
            yield last, cells
            e.clear()


def rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(path, row, cells) of every row of the sheet, from (path, content) of whole files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[tuple[int, list[str | None]]] = []
                if content.as_py() is None:
                    continue
                for r in sheet_rows(content.as_py(), sheet):
                    held.append(r)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pydict({"path": [path] * len(held), "row": [n for n, _ in held], "cells": [c for _, c in held]}, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(held), "row": [n for n, _ in held], "cells": [c for _, c in held]}, schema=schema)

    return files.select("path", "content").mapInArrow(read, ROWS)


def with_header(sheet: DataFrame, names: list[str]) -> DataFrame:
    """Columns by the names in each file's first row, whatever their order there; a file without one of them raises when it is read.

    sheet: what rows() gives.  Rows that are empty are left out, and path and row are kept.
    """
    first = sheet.groupBy("path").agg(F.min_by("cells", "row").alias("_names"), F.min("row").alias("_first"))
    place = [F.array_position("_names", F.lit(n)) for n in names]
    missing = F.concat_ws(", ", *[F.when(F.coalesce(p, F.lit(0)) == 0, F.lit(n)) for p, n in zip(place, names, strict=True)])
    first = first.select("path", "_first", F.when(missing == "", F.array(*[p.cast("int") for p in place])).otherwise(F.raise_error(F.concat(F.lit("missing columns "), missing))).alias("_place"))
    d = sheet.join(first, "path").where((F.col("row") > F.col("_first")) & F.exists("cells", lambda c: c.isNotNull()))
    return d.select("path", "row", *[F.get("cells", F.get("_place", F.lit(k)) - 1).alias(n) for k, n in enumerate(names)])


def read_workbooks(spark: SparkSession, path: str, names: list[str], sheet: str | None = None) -> DataFrame:
    """The named columns of a sheet of each workbook under a path; all text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return with_header(rows(files, sheet), names)


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """The bytes of a workbook: numbers as numbers, None left out, all else as text."""

    def name(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(at: str, v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel, kinds = (f"http://schemas.openxmlformats.org/{x}" for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006/content-types"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        links = rel.replace("officeDocument", "package")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{links}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{links}">' + "".join(f'<Relationship Id="s{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="s{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for k, held in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(cell(f"{name(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(held, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def as_workbooks(df: DataFrame, key: str, sheet: str = "Sheet1") -> DataFrame:
    """(path, content): one workbook for each value of a key, with a header; each is made in one task, so a key has as many rows as a workbook may."""
    names = [c for c in df.columns if c != key]

    def make(group: tuple, t: pa.Table) -> pa.Table:
        body = [list(r) for r in zip(*[t.column(n).to_pylist() for n in names], strict=True)]
        return pa.table({"path": [f"{key}={group[0].as_py()}.xlsx"], "content": pa.array([workbook({sheet: [names, *body]})], pa.binary())})

    return df.groupBy(key).applyInArrow(make, "path string, content binary")
