"""Document readers: word-processor files, plain text, tables and recognised images, and which of them reads a file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftmill.functions.text import sanitized, sniffed
from weftmill.sources.io import decode

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC_TITLE = "{http://purl.org/dc/elements/1.1/}title"
#: Unpacked bytes of a part of a file that are read at most; a larger one makes the file unreadable.
MOST_XML = 200_000_000
#: Sides of a picture below which it is an icon, its pixels above which it is not recognised, and words without which what
#: was recognised is noise.
LEAST_SIDE, MOST_PIXELS, LEAST_WORDS = 300, 40_000_000, 8


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist() or z.getinfo(name).file_size > MOST_XML:
        return None
    data = z.read(name)
    return None if b"<!DOCTYPE" in data[:1000] else ElementTree.fromstring(data)


def _runs(p: ElementTree.Element) -> str:
    return "".join({f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, "") for x in p.iter()).strip()


def docx(data: bytes | None) -> tuple[str, str, str | None]:
    """(text, title, error) of a word-processor file: headings with their marks, paragraphs, then tables row by row.

    Null, broken and oversized files give empty texts and what was wrong.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            body, styles, core = (_part(z, n) for n in ("word/document.xml", "word/styles.xml", "docProps/core.xml"))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError, OSError) as e:
        return "", "", f"{type(e).__name__}: {e}"[:500]
    if body is None:
        return "", "", "no document part"
    names = {s.get(f"{_W}styleId"): (s.find(f"{_W}name").get(f"{_W}val", "") if s.find(f"{_W}name") is not None else "") for s in styles.iter(f"{_W}style")} if styles is not None else {}
    inside = {p for t in body.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    out = []
    for p in body.iter(f"{_W}p"):
        text = _runs(p)
        if p in inside or not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = names.get(style.get(f"{_W}val"), style.get(f"{_W}val") or "").lower() if style is not None else ""
        level = re.sub(r"\D", "", name) or "2"
        out.append(f"{'#' * min(int(level), 6)} {text}" if name.startswith("heading") else text)
    for t in body.iter(f"{_W}tbl"):
        rows = [[" ".join(filter(None, map(_runs, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        out += pairs(rows)
    title = core.find(_DC_TITLE) if core is not None else None
    return "\n\n".join(out), (title.text or "").strip() if title is not None else "", None


def pairs(rows: list[list[str]]) -> list[str]:
    """Rows of a table below its first, as "Header: value; ...", without empty cells; nothing for a table of fewer than two rows."""
    filled = [r for r in rows if any(r)]
    head = filled[0] if filled else []
    return ["; ".join(f"{head[i]}: {v}" if i < len(head) and head[i] else v for i, v in enumerate(r) if v) for r in filled[1:]]


def table_text(rows: Column) -> Column:
    """``pairs`` of an array of rows of cells as one text, with line ends within cells as spaces; null for a table of fewer than two rows."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")))), lambda r: F.exists(r, lambda c: c != ""))
    head = clean[0]
    cell = lambda v, i: F.when(F.coalesce(F.get(head, i), F.lit("")) != "", F.concat(F.get(head, i), F.lit(": "), v)).otherwise(v)
    line = lambda r: F.array_join(F.filter(F.transform(r, lambda v, i: F.when(v != "", cell(v, i))), lambda x: x.isNotNull()), "; ")
    return F.when(F.size(clean) >= 2, F.array_join(F.transform(F.slice(clean, F.lit(2), F.size(clean)), line), "\n"))


def recognisable(width: Column, height: Column) -> Column:
    """Whether a picture is worth recognising: no icon, and not so large that decoding it alone takes gigabytes."""
    return (width >= LEAST_SIDE) & (height >= LEAST_SIDE) & (width * height <= MOST_PIXELS)


def recognised(text: Column) -> Column:
    """What was recognised in a picture; "" if it has too few words, as photographs give."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))
    return F.when(words >= LEAST_WORDS, text).otherwise("")


_READ = StructType([StructField(n, StringType()) for n in ("text", "title", "error")])


@F.pandas_udf(_READ)
def _read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for contents, kinds in parts:
        out = [docx(c) if k == "docx" else (decode(c) or "", "", None) if k == "txt" else ("", "", None) for c, k in zip(contents, kinds)]
        yield pd.DataFrame(out, columns=_READ.names)


def read(files: DataFrame, content: str = "content", kind: str = "kind") -> DataFrame:
    """``files`` with kind, text, title, error and needs_ocr: each read by what its first bytes tell, else by its stated kind.

    Word-processor and plain files are read here; pictures and PDF files need an adapter and are marked for it.
    """
    real = F.coalesce(sniffed(F.col(content)), F.col(kind), F.lit("txt"))
    d = files.withColumn(kind, F.when(real.isin("pdf", "docx", "image"), real).otherwise("txt"))
    d = d.withColumn("_r", _read(F.col(content), F.col(kind)))
    return d.select(*d.drop("_r").columns, sanitized(F.col("_r.text")).alias("text"), F.col("_r.title").alias("title"), F.col("_r.error").alias("error"), F.col(kind).isin("pdf", "image").alias("needs_ocr"))
