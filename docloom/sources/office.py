"""Office documents (docx, pptx, xlsx) as blocks, read from their bytes.

These formats are zip archives of XML.  ``blocks_of`` takes files as Spark's
``binaryFile`` source reads them, from any file system and also as a stream, and
parses each in an Arrow batch; a file that can't be parsed is a row with an error.
Text, markdown and counts are Columns over the blocks.  ``docx_files`` goes the
other way.  A part of an archive that unpacks to more than ``LARGEST`` bytes is an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as XML
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.files import source

LARGEST = 256 << 20
#: Namespaces of the formats.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"

BLOCK = "struct<kind:string,level:int,page:int,text:string,cells:array<string>>"
_BLOCK = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("page", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.string()))])


def _part(archive: zipfile.ZipFile, name: str) -> XML.Element:
    if archive.getinfo(name).file_size > LARGEST:
        raise ValueError(f"{name} is larger than {LARGEST} bytes")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096]:  # entities could make a small file very large
        raise ValueError(f"{name} has a document type")
    return XML.fromstring(data)


def _parts(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    """Names of numbered parts, by number."""
    found = ((re.fullmatch(pattern, n), n) for n in archive.namelist())
    return [n for _, n in sorted((int(m[1]), n) for m, n in found if m)]


def _said(element: XML.Element, space: str) -> str:
    """The text of runs, with tabs and line ends."""
    marks = {f"{{{space}}}tab": "\t", f"{{{space}}}br": "\n", f"{{{space}}}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{{{space}}}t" else marks.get(x.tag, "") for x in element.iter())


def _block(kind: str, text: str = "", level: int | None = None, page: int | None = None, cells: list[str] | None = None) -> dict:
    return {"kind": kind, "level": level, "page": page, "text": text, "cells": cells}


def word_blocks(archive: zipfile.ZipFile) -> Iterator[dict]:
    tag = lambda name: f"{{{WORD}}}{name}"
    body = _part(archive, "word/document.xml").find(tag("body"))
    for x in body if body is not None else ():
        if x.tag == tag("p"):
            style = x.find(f"{tag('pPr')}/{tag('pStyle')}")
            level = re.fullmatch(r"[Hh]eading\s?([1-9])", style.get(tag("val"), "") if style is not None else "")
            yield _block("heading" if level else "paragraph", _said(x, WORD), int(level[1]) if level else None)
        elif x.tag == tag("tbl"):
            for row in x.iter(tag("tr")):
                yield _block("row", cells=[_said(c, WORD) for c in row.findall(tag("tc"))])
            yield _block("table")


def slide_blocks(archive: zipfile.ZipFile) -> Iterator[dict]:
    tag = lambda name: f"{{{DRAWING}}}{name}"
    for page, name in enumerate(_parts(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
        yield _block("slide", page=page)
        root = _part(archive, name)
        in_tables = set()
        for table in root.iter(tag("tbl")):
            in_tables.update(table.iter(tag("p")))
            for row in table.iter(tag("tr")):
                yield _block("row", page=page, cells=[_said(c, DRAWING) for c in row.findall(tag("tc"))])
            yield _block("table", page=page)
        for x in root.iter(tag("p")):
            if x not in in_tables and (text := _said(x, DRAWING)):
                yield _block("paragraph", text, page=page)


def sheet_blocks(archive: zipfile.ZipFile) -> Iterator[dict]:
    tag = lambda name: f"{{{SHEET}}}{name}"
    shared = [_said(x, SHEET) for x in _part(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in archive.namelist() else []
    for page, name in enumerate(_parts(archive, r"xl/worksheets/sheet(\d+)\.xml"), 1):
        for row in _part(archive, name).iter(tag("row")):
            cells: list[str] = []
            for c in row.findall(tag("c")):
                place = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    place = place * 26 + ord(letter) - 64
                cells += [""] * (place - 1 - len(cells))  # cells that aren't stored
                value = c.find(tag("v"))
                cells.append(shared[int(value.text)] if c.get("t") == "s" else _said(c, SHEET) if c.get("t") == "inlineStr" else value.text or "" if value is not None else "")
            yield _block("row", page=page, cells=cells)
        yield _block("table", page=page)


#: File type to the function of an archive.
FORMATS = {"docx": word_blocks, "pptx": slide_blocks, "xlsx": sheet_blocks}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            kind = path.rpartition(".")[2].lower() if path else None
            blocks, images, error = [], 0, None
            try:
                if kind not in FORMATS:
                    raise ValueError(f"no office document: {path}")
                with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as archive:
                    blocks = list(FORMATS[kind](archive))
                    images = sum(bool(re.match(r"(word|ppt|xl)/media/", n)) for n in archive.namelist())
            except Exception as e:  # whatever is wrong with a file is its own row's error
                blocks, images, error = [], 0, f"{type(e).__name__}: {e}"
            yield pa.record_batch([pa.array([path]), pa.array([kind], pa.string()), pa.array([blocks], pa.list_(_BLOCK)), pa.array([images], pa.int32()), pa.array([error], pa.string())], ["path", "file_type", "blocks", "n_images", "error"])


def blocks_of(files: DataFrame) -> DataFrame:
    """path, file_type, blocks, n_images, error of files (path, content), one row each; also of a stream."""
    return files.select("path", "content").mapInArrow(_parsed, f"path string, file_type string, blocks array<{BLOCK}>, n_images int, error string")


@source("office")
def office_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The office documents in a folder; with ``stream``, as a stream of files that arrive."""
    if not stream:
        return blocks_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(path))
    schema = "path string, modificationTime timestamp, length long, content binary"
    return blocks_of(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(path))


def of_kind(blocks: Column, *kinds: str) -> Column:
    return F.filter(blocks, lambda b: b["kind"].isin(*kinds))


def paragraphs(blocks: Column) -> Column:
    """Texts of paragraphs and headings, and cells of tables joined by tabs."""
    return F.transform(of_kind(blocks, "paragraph", "heading", "row"), lambda b: F.coalesce(F.array_join(b["cells"], "\t"), b["text"]))


def text_of(blocks: Column) -> Column:
    return F.array_join(paragraphs(blocks), "\n")


def markdown_of(blocks: Column) -> Column:
    """Headings with their marks, rows of tables between pipes, slides under a heading of their own, blank lines between."""
    row = lambda b: F.concat(F.lit("| "), F.array_join(F.transform(b["cells"], lambda c: F.regexp_replace(c, r"[|\n\t]", " ")), " | "), F.lit(" |"))
    one = lambda b: (
        F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.least(b["level"], F.lit(6))), F.lit(" "), b["text"]))
        .when(b["kind"] == "row", row(b))
        .when(b["kind"] == "slide", F.concat(F.lit("## "), b["page"].cast("string")))
        .when(b["kind"] == "paragraph", b["text"])
    )
    shown = F.filter(F.transform(blocks, lambda b: F.struct(b["kind"].alias("kind"), one(b).alias("md"))), lambda x: F.coalesce(x["md"], F.lit("")) != "")
    gap = lambda i, x: F.when(i == 0, F.lit("")).when((x["kind"] == "row") & (F.get(shown, i - 1)["kind"] == "row"), F.lit("\n")).otherwise(F.lit("\n\n"))
    return F.array_join(F.transform(shown, lambda x, i: F.concat(gap(i, x), x["md"])), "")


def docx_bytes(blocks: list[dict]) -> bytes:
    """A docx file of paragraphs (level null) and headings; characters that XML can't hold are left out."""
    plain = lambda t: escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", t)).replace("\r", "&#13;")
    style = lambda n: f'<w:pPr><w:pStyle w:val="Heading{n}"/></w:pPr>' if n else ""
    runs = lambda t: "<w:br/>".join(f'<w:t xml:space="preserve">{x}</w:t>' for x in plain(t).split("\n"))
    body = "".join(f"<w:p>{style(b['level'])}<w:r>{runs(b['text'] or '')}</w:r></w:p>" for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        archive.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def docx_files(rows: DataFrame, path: str, blocks: str) -> DataFrame:
    """path, content: each row's ``blocks`` (array of structs of level and text) as the bytes of a docx file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.record_batch([pa.array([name], pa.string()), pa.array([docx_bytes(own.as_py() or [])], pa.binary())], ["path", "content"])

    return rows.select(F.col(path).alias("path"), F.col(blocks).alias("blocks")).mapInArrow(run, "path string, content binary")
