"""Files as rows: recursive scans, text decoding and the office and book formats that the standard library can open.

All readers go through Spark's ``binaryFile`` source, so any store that Spark reads will do, and a file that can't be read gives a null text in place of
a failed job. Formats that need absent libraries (images) raise ``MissingReader`` by name.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.pdf import pdf_text

#: Extensions by reader.
TEXT, SHEETS, DOCUMENTS = ("txt", "text", "md", "markdown", "json", "jsonl", "csv", "html", "htm", "log", "py", "xml", "yaml", "yml"), ("xlsx",), ("docx", "pptx", "epub", "odt", "eml")
STRUCTURED = ("pdf", "docx", "md", "markdown", "html", "htm", "txt", "text")


class MissingReader(RuntimeError):
    """A format whose reader needs a library that isn't there."""


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, extension, modified, content): every file below a path, of these extensions if given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    found = reader.load(path)
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("modificationTime").alias("modified"), "content")


def resolve(spark: SparkSession, arguments: list[str], exists: Callable[[str], bool] | None = None) -> DataFrame:
    """(source, text): arguments that name files are scanned and read, others are texts themselves (source ``__text__``)."""
    def known(a: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    test = exists or known
    paths = [a for a in arguments if a.strip() and len(a) < 4096 and "\n" not in a and test(a)]
    out = spark.createDataFrame([("__text__", a) for a in arguments if a not in paths], "source string, text string")
    for p in paths:
        out = out.union(texts(scan(spark, p)).select(F.col("path").alias("source"), "text"))
    return out


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, else GB18030 where that decodes without loss, else Latin-1, which always does."""
    utf8 = content.cast("string")

    @F.arrow_udf("string")
    def other(column: pa.Array) -> pa.Array:
        out = []
        for b in column.to_pylist():
            for codec in ("gb18030", "latin-1"):
                try:
                    out.append(None if b is None else b.decode(codec))
                    break
                except UnicodeDecodeError:
                    continue
        return pa.array(out, pa.string())

    return F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "^﻿", "")).otherwise(other(content))


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _joined(e, leaf: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == leaf)


def docx_parts(content: bytes) -> Iterator[tuple[str, int | None, str]]:
    """(kind, level, text) of a word-processor file in order: headings by style, paragraphs, and tables as `` | `` rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in _xml(z, "word/document.xml").iter() if _tag(e) == "body")
        for e in body:
            if _tag(e) == "p" and (text := _joined(e).strip()):
                style = next((v for x in e.iter() if _tag(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
                m = re.search(r"(?i)(?:heading|标题)\s*(\d)", style)
                yield ("heading", int(m[1]) - 1, text) if m else ("paragraph", None, text)
            elif _tag(e) == "tbl":
                rows = [" | ".join(_joined(c).strip() for c in r if _tag(c) == "tc") for r in e if _tag(r) == "tr"]
                yield "table", None, "\n".join(rows)


def docx_text(content: bytes) -> str:
    """Headings with a mark before them; tables after all paragraphs."""
    parts = list(docx_parts(content))
    return "\n\n".join([f"# {t}" if k == "heading" else t for k, _, t in parts if k != "table"] + [t for k, _, t in parts if k == "table"])


def xlsx_rows(content: bytes) -> Iterator[tuple[str, list[str]]]:
    """(sheet, cells) of every row that isn't blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_joined(e) for e in _xml(z, "xl/sharedStrings.xml") if _tag(e) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [e.attrib.get("name", "") for e in _xml(z, "xl/workbook.xml").iter() if _tag(e) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for title, name in zip(titles, sheets):
            for row in (e for e in _xml(z, name).iter() if _tag(e) == "row"):
                cells: list[str] = []
                for c in row:
                    column = 0
                    for letter in re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]:
                        column = 26 * column + ord(letter) - 64
                    cells += [""] * max(0, column - 1 - len(cells))
                    value = next((x.text or "" for x in c if _tag(x) == "v"), "")
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else _joined(c) if c.attrib.get("t") == "inlineStr" else value)
                if any(x.strip() for x in cells):
                    yield title, cells


def xlsx_text(content: bytes) -> str:
    """Sheets under their names, cells between tabs, blank rows dropped."""
    out: dict[str, list[str]] = {}
    for sheet, cells in xlsx_rows(content):
        out.setdefault(sheet, []).append("\t".join(cells))
    return "\n\n".join(f"[Sheet: {k}]\n" + "\n".join(v) for k, v in out.items())


def sheet_lines(content: bytes) -> list[str]:
    """``head：value; …`` for each data row, with the sheet's name after it unless it is a default one."""
    heads: dict[str, list[str]] = {}
    out = []
    for sheet, cells in xlsx_rows(content):
        if sheet not in heads:
            heads[sheet] = cells
            continue
        line = "; ".join(f"{h}：{v}" for h, v in zip(heads[sheet], cells) if v.strip())
        out.append(line + ("" if "sheet" in sheet.lower() else f" ——{sheet}"))
    return out


def pptx_text(content: bytes) -> str:
    """Slides in order, their shapes from top to bottom and left to right."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        out = []
        for name in slides:
            shapes = []
            for i, e in enumerate(x for x in _xml(z, name).iter() if _tag(x) in ("sp", "graphicFrame")):
                off = next((x.attrib for x in e.iter() if _tag(x) == "off"), {})
                text = "\n".join(t for p in e.iter() if _tag(p) == "p" if (t := _joined(p).strip()))
                if text:
                    shapes.append((int(off.get("y", 0)) // 10, int(off.get("x", 0)), i, text))
            out.append("\n".join(s[-1] for s in sorted(shapes)))
    return "\n\n".join(x for x in out if x)


def epub_text(content: bytes) -> str:
    """Chapters in the order of the book's spine, or of their names without one."""
    from kbspark.sources.html import parse_blocks

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        order = sorted(n for n in names if re.search(r"\.x?html?$", n))
        if opf := next((n for n in names if n.endswith(".opf")), None):
            root = _xml(z, opf)
            folder = opf.rpartition("/")[0]
            items = {e.attrib.get("id"): e.attrib.get("href", "") for e in root.iter() if _tag(e) == "item"}
            spine = [items.get(e.attrib.get("idref"), "") for e in root.iter() if _tag(e) == "itemref"]
            order = [n for h in spine if (n := f"{folder}/{h}".lstrip("/")) in names] or order
        return "\n\n".join(t for n in order if (t := "\n".join(b[2] for b in parse_blocks(z.read(n).decode("utf-8", "replace")))))


def odt_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n\n".join(t for e in _xml(z, "content.xml").iter() if _tag(e) in ("p", "h") if (t := "".join(e.itertext()).strip()))


def eml_text(content: bytes) -> str:
    import email
    import email.policy

    m = email.message_from_bytes(content, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    return "\n\n".join(x for x in (m.get("subject", ""), body.get_content() if body else "") if x)


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}]+)")
_RTF_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "generator"}


def rtf_text(content: bytes) -> str:
    """Text without control words; groups of tables and pictures are left out."""
    out, hidden, stack = [], False, []
    for m in _RTF.finditer(content.decode("latin-1")):
        byte, code, word, _, mark, brace, plain = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif word in _RTF_HIDDEN or mark == "*":
            hidden = True
        elif not hidden:
            out.append(chr(int(byte, 16)) if byte else chr(int(code) % 65536) if code else "\n" if word in ("par", "line") else "\t" if word == "tab" else mark if mark in ("\\", "{", "}") else (plain or "").replace("\r", "").replace("\n", ""))
    return "".join(out).strip()


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "epub": epub_text, "odt": odt_text, "eml": eml_text, "rtf": rtf_text, "pdf": pdf_text}


def reader_of(extension: str) -> Callable[[bytes], str]:
    if extension not in READERS:
        raise MissingReader(f"no reader for .{extension} here")
    return READERS[extension]


#: What readers raise for broken, encrypted or oddly compressed files.
UNREADABLE = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, LookupError, ValueError, ArithmeticError, RuntimeError, NotImplementedError, EOFError, StopIteration)


def texts(files: DataFrame) -> DataFrame:
    """``files`` (of ``scan``) with ``text`` in place of the content; null where a file can't be read."""

    @F.arrow_udf("string")
    def office(content: pa.Array, extension: pa.Array) -> pa.Array:
        out = []
        for b, x in zip(content.to_pylist(), extension.to_pylist()):
            try:
                out.append(reader_of(x)(b) if x in READERS and b is not None else None)
            except UNREADABLE:
                out.append(None)
        return pa.array(out, pa.string())

    other = F.when(F.col("extension").isin("png", "jpg", "jpeg"), F.lit(None).cast("string")).otherwise(decoded(F.col("content")))
    return files.withColumn("text", F.when(F.col("extension").isin(*READERS), office(F.col("content"), F.col("extension"))).otherwise(other)).drop("content")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files as strings; lines that don't fit the header are dropped."""
    return spark.read.option("header", "true").option("mode", "DROPMALFORMED").csv(path)


def is_structured(extension: Column) -> Column:
    return F.lower(extension).isin(*STRUCTURED)
