"""Workbooks (.xlsx) with the standard library: a scan of a sheet as strings, and a writer of several sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: rows of a sheet, without the header.
SHEET_ROWS = 1_048_575
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def sheet_names(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet to the part that holds it."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): "xl/" + links[s.get(LINK)].removeprefix("/xl/") for s in sheets}


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet, the first one by default, read as a stream of elements."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = sheet_names(book)
        if sheet is not None and sheet not in names:
            raise ValueError(f"no sheet {sheet}; there are {list(names)}")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        with book.open(names[sheet] if sheet else next(iter(names.values()))) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{MAIN}c")):
                    at = column_number(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    value = cell.find(f"{MAIN}v")
                    if cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield out
                row.clear()


def find_sheet(spark: SparkSession, path: str, phrase: str | None = None) -> str:
    """The first sheet whose header has the phrase column, the one asked for or a known one; ValueError with the sheets there are where none has."""
    from .delimited import PHRASE_HEADERS, header_key

    wanted = {header_key(phrase)} if phrase else set(PHRASE_HEADERS)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                with zipfile.ZipFile(io.BytesIO(data)) as book:
                    names = list(sheet_names(book))
                headers = [[h or "" for h in next(rows_of(data, n), [])] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(headers, pa.list_(pa.string()))], ["name", "header"])

    sheets = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, header array<string>").collect()
    for s in sheets:
        if wanted & set(map(header_key, s["header"])):
            return s["name"]
    raise ValueError(f"no sheet has the phrase column; there are {[s['name'] for s in sheets]}")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The sheet's columns as strings, named by its first row, and source_row. A workbook is one file of bounded size, read in one task."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").mapInArrow(_header_reader(sheet), "header array<string>").first()
    header = [h or f"column_{k}" for k, h in enumerate(first["header"] if first else [])]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                block: list[list[str | None]] = []
                for k, row in enumerate(rows_of(content.as_py(), sheet)):
                    if k:
                        block.append([*(row + [None] * len(header))[: len(header)], k])
                    if len(block) >= 4096:
                        yield _batch(block, header)
                        block = []
                yield _batch(block, header)

    schema = ", ".join([f"c{k} string" for k in range(len(header))] + ["source_row bigint"])
    return files.select("content").mapInArrow(run, schema).toDF(*header, "source_row")


def _header_reader(sheet):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([next(rows_of(content.as_py(), sheet), [])], pa.list_(pa.string()))], ["header"])

    return run


def _batch(block, header):
    kinds = [pa.string()] * len(header) + [pa.int64()]
    columns = list(zip(*block, strict=True)) if block else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f"c{k}" for k in range(len(header))] + ["source_row"])


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, tuple[list[str], Iterable[Iterable]]], most: int = SHEET_ROWS) -> dict[str, int]:
    """Writes (columns, rows) of each sheet; a sheet with more than `most` rows goes on in numbered ones. Returns the rows of each.

    A workbook is for people: rows come as an iterator (toLocalIterator), so the driver holds one at a time.
    """
    counts: dict[str, int] = {}
    parts: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, (columns, rows) in sheets.items():
            source, number, more = iter(rows), 1, True
            while more:
                title = name if number == 1 else f"{name} {number}"
                parts.append(title)
                counts[title], more = 0, False
                with book.open(f"xl/worksheets/sheet{len(parts)}.xml", "w") as out:
                    out.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                    out.write(("<row>" + "".join(map(_cell, columns)) + "</row>").encode())
                    for row in source:
                        out.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
                        counts[title] += 1
                        if counts[title] >= most:
                            more = True
                            break
                    out.write(b"</sheetData></worksheet>")
                if more and (following := next(source, None)) is not None:
                    from itertools import chain

                    source = chain([following], source)
                else:
                    more = False
                number += 1
        relation = LINK[1:-3]
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="{escape(t)}" sheetId="{k}" r:id="r{k}"/>' for k, t in enumerate(parts, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="r{k}" Type="{relation}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(parts) + 1)) + "</Relationships>")
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(parts) + 1))
        book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + kinds + "</Types>")
    return counts


def result_sheets(decided: DataFrame, review: DataFrame, summary: DataFrame, metadata: list[tuple[str, str]]) -> dict:
    """The sheets of a result: both intents, garbage, the review queue, the cluster summary and where the run came from."""
    from ..operators.clusters import compact

    columns = ["phrase", "search_volume", "cluster", "p_commercial", "p_informational", "p_garbage"]
    queue = ["phrase", "intent", "review_reason", "correct_intent", "reviewer_notes"]
    sheet = lambda df: (df.columns, (tuple(r) for r in df.toLocalIterator()))
    return {
        "Commercial clusters": sheet(compact(decided.where(F.col("intent") == "commercial"), columns)),
        "Informational clusters": sheet(compact(decided.where(F.col("intent") == "informational"), columns)),
        "Garbage": sheet(compact(decided.where(F.col("intent") == "garbage"), columns)),
        "Human review": sheet(compact(review.withColumn("phrase", F.col("normalized")) if "phrase" not in review.columns else review, queue)),
        "Cluster summary": sheet(summary),
        "_Workflow": (["Parameter", "Value"], metadata),
    }
