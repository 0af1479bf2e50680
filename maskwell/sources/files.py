"""Reading documents from files: directory scan, dispatch by extension, text extraction."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a scan passes over, the separator of table cells.
PASSED_OVER = ["output", ".git", "__pycache__", "venv"]
CELL_SEPARATOR = " | "
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _runs(node: ElementTree.Element) -> str:
    """The text of a paragraph: its runs, those of links included; tabs and breaks as characters."""
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab" and x.get(f"{_W}val") is None:
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def docx_text(content: bytes) -> str:
    """The body's paragraphs, then each row of its tables with cells joined, all by line ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        return ""
    lines = [_runs(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            cells = []
            for cell in row.findall(f"{_W}tc"):
                span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                # a merged cell counts once for each column it spans
                cells += ["\n".join(_runs(p) for p in cell.findall(f"{_W}p"))] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
            lines.append(CELL_SEPARATOR.join(cells))
    return "\n".join(lines)


def pdf_text(content: bytes) -> str:
    """The text of a PDF, by pdfminer where it is installed."""
    try:
        from pdfminer.high_level import extract_text
    except ImportError as e:
        raise ImportError("reading PDF files needs pdfminer.six, or another extractor in extractors['.pdf']") from e
    return extract_text(io.BytesIO(content))


EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pdf": pdf_text}


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, with its dot; empty without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``files``(path, content) -> path, text, error: the text, or null and why not.

    A file that can't be read or has another extension has an error and doesn't
    end the task. Null content: an error. Arrow batches go one by one, so a
    worker holds one batch of files.
    """
    known = EXTRACTORS if extractors is None else extractors

    def one(ext: str, content: bytes | None) -> tuple[str | None, str | None]:
        if ext not in known:
            return None, f"Unsupported file format: {ext}"
        if content is None:
            return None, "File not found"
        try:
            return known[ext](content), None
        except Exception as e:  # noqa: BLE001 - one file's failure is its row's error
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [one(e.as_py() or "", c.as_py()) for e, c in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string())], ["path", "text", "error"])

    return files.select("path", extension(F.col("path")).alias("extension"), "content").mapInArrow(run, "path string, text string, error string")


def scan(spark: SparkSession, folder: str, recursive: bool = False, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """doc_id (the file's name without extension), path, text, error of the .pdf and .docx
    files of a folder, those under PASSED_OVER left out. Any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx,PDF,DOCX}").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = folder.rstrip("/")
    below = F.regexp_extract("path", "^(?:.*?)" + "\\Q" + root.split(":", 1)[-1].lstrip("/") + "\\E/(.*)$", 1)
    inside = F.slice(F.split(below, "/"), F.lit(1), F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    files = files.where(~F.arrays_overlap(inside, F.array(*map(F.lit, PASSED_OVER))))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return extract_text(files, extractors).select(stem.alias("doc_id"), "path", "text", "error")


def write_docx(paragraphs: list[str], tables: list[list[list[str]]] | None = None) -> bytes:
    """A minimal document, for fixtures: paragraphs and tables of cells."""

    def paragraph(text: str) -> ElementTree.Element:
        p = ElementTree.Element(f"{_W}p")
        r = ElementTree.SubElement(p, f"{_W}r")
        for i, line in enumerate(text.split("\n")):
            if i:
                ElementTree.SubElement(r, f"{_W}br")
            for j, piece in enumerate(line.split("\t")):
                if j:
                    ElementTree.SubElement(r, f"{_W}tab")
                t = ElementTree.SubElement(r, f"{_W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                t.text = piece
        return p

    document = ElementTree.Element(f"{_W}document")
    body = ElementTree.SubElement(document, f"{_W}body")
    body.extend(paragraph(x) for x in paragraphs)
    for table in tables or []:
        tbl = ElementTree.SubElement(body, f"{_W}tbl")
        for row in table:
            tr = ElementTree.SubElement(tbl, f"{_W}tr")
            for cell in row:
                ElementTree.SubElement(tr, f"{_W}tc").append(paragraph(cell))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", ElementTree.tostring(document, "utf-8", xml_declaration=True))
    return out.getvalue()
