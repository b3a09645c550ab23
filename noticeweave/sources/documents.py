"""Attached documents: texts of ODT, DOCX and ZIP files, with their limits."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_CHARS, MAX_BYTES, MAX_INNER = 60_000, 15 * 1024 * 1024, 5


def xml_text(xml: str) -> str:
    """Text of an office document's XML: paragraphs on lines, tabs and breaks kept."""
    s = re.sub(r"<(?:text:line-break|w:br)[^>]*/?>|</(?:text:p|text:h|w:p)>", "\n", xml)
    s = re.sub(r"<(?:text:tab|w:tab)[^>]*/?>", "\t", s)
    s = re.sub(r"<text:s[^>]*/>", " ", s)
    s = re.sub(r"<[^>]+>", "", s)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = s.replace(a, b)
    return re.sub(r"\n\s*\n+", "\n", s).strip()


def document_text(data: bytes | None, depth: int = 0) -> str:
    """Text of an ODT, DOCX or ZIP file, of at most five inner files; anything else, and any error, gives ''."""
    if not data or len(data) > MAX_BYTES or data[:2] != b"PK":
        return ""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            for inner in ("content.xml", "word/document.xml"):
                if inner in names and z.getinfo(inner).file_size <= 4 * MAX_BYTES:
                    return xml_text(z.read(inner).decode("utf-8", errors="replace"))[:MAX_CHARS]
            if depth:
                return ""
            parts = [document_text(z.read(n), 1) for n in sorted(names)[:MAX_INNER] if z.getinfo(n).file_size < MAX_BYTES]
            return "\n".join(filter(None, parts))[:MAX_CHARS]
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, NotImplementedError, EOFError):
        return ""


@F.pandas_udf(StringType())
def text_of(data: pd.Series) -> pd.Series:
    return pd.Series([document_text(None if d is None else bytes(d)) for d in data], dtype=object)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of the files under ``path``; the size limit is pushed to the scan."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_BYTES)
    return files.select("path", text_of("content").alias("text"))


def filename_of(disposition):
    """File name of a content-disposition header, the extended form first."""
    ext = F.regexp_extract(disposition, r"(?i)filename\*\s*=\s*(?:utf-8|[\w-]+)''([^;]+)", 1)
    plain = F.regexp_extract(disposition, r"(?i)filename\s*=\s*\"?([^\";]+)\"?", 1)
    return F.coalesce(F.nullif(F.try_url_decode(F.nullif(ext, F.lit(""))), F.lit("")), F.nullif(F.coalesce(F.try_url_decode(plain), plain), F.lit("")))
