"""Reading rule files and documents."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from promptlens.functions.patterns import pyre
from promptlens.operators.records import chunk

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RULE = "id string, pattern string, type string, ignore_case boolean, severity int, description string"


def read_rules(spark: SparkSession, path: str) -> dict[str, list[tuple[str, str, bool]]]:
    """Ordered block and flag rules of JSON-lines files; blank, ``#`` and broken lines are skipped, a later id replaces an earlier one.

    A rule without an id is named after its file and line.  A pattern counts
    if Java, which runs it, can read it.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = files.where("trim(line) <> '' and not trim(line) like '#%'").select("file", "at", F.from_json("line", RULE).alias("r"))
    rows = lines.where("r.pattern is not null").select("file", "at", "r.*").orderBy("file", "at").collect()  # rule files are small by nature
    compiled = spark._jvm.java.util.regex.Pattern
    found: dict[str, tuple[str, str, bool, str]] = {}
    for r in rows:
        try:
            compiled.compile(pyre(r.pattern))
        except IllegalArgumentException:
            continue
        name = r.id or f"{PurePosixPath(r.file).stem}_{r.at + 1}"
        found.pop(name, None)
        found[name] = (name, r.pattern, r.ignore_case is not False, "block" if r.type == "block" else "flag")
    return {kind: [x[:3] for x in found.values() if x[3] == kind] for kind in ("block", "flag")}


_TEXT = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|T\*|T[dDm]\b|'|\"|TJ|Tj|-?\d+(?:\.\d+)?|\[|\]", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_streams(content: bytes) -> list[tuple[bytes, bytes]]:
    """(dictionary, data) of each stream of a PDF, inflated where it was deflated."""
    out = []
    for m in re.finditer(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>))*>>)*)>>\s*stream\r?\n", content):
        end = content.find(b"endstream", m.end())
        data = content[m.end() : end if end >= 0 else len(content)]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        out.append((m[1], data))
    return out


def pdf_text(content: bytes) -> str:
    """The text of each page's content stream, pages in order and blank ones left out.  Only text shown by literal strings is read: fonts that map codes to other characters are not followed."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    pages = []
    for head, data in pdf_streams(content):
        if b"/Subtype" in head or not re.search(rb"\bBT\b", data):
            continue
        parts: list[bytes] = []
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            for token in _TEXT.findall(block):
                if token[:1] == b"(":
                    parts.append(re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else b"" if e[1].strip() == b"" else _ESCAPED.get(e[1], e[1]), token[1:-1], flags=re.S))
                elif token in (b"Td", b"TD", b"Tm", b"T*", b"'", b'"') and parts and parts[-1] != b"\n":
                    parts.append(b"\n")
            parts.append(b"\n")
        text = b"".join(parts).decode("latin-1").strip()
        if text:
            pages.append(text)
    return "\n".join(pages)


def pdf_images(content: bytes) -> list[tuple[int, str, bytes]]:
    """(index, file name by its hash, bytes) of each JPEG in a PDF."""
    found = [data for head, data in pdf_streams(content) if b"/Image" in head and b"DCTDecode" in head]
    return [(k, f"{hashlib.md5(d.rstrip()).hexdigest()[:12]}.jpeg", d.rstrip()) for k, d in enumerate(found)]


def images_of_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, index, name, format, content and size_bytes of every JPEG in PDF files."""

    def run(batches):
        for b in batches:
            rows = [(p, *x) for p, c in zip(b["path"], b["content"], strict=True) for x in pdf_images(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "index", "name", "content"])

    own = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".pdf")).select("path", "content")
    return own.mapInPandas(run, "path string, index int, name string, content binary").withColumns({"format": F.lit("jpeg"), "size_bytes": F.octet_length("content").cast("long")})


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with cells joined by `` | ``."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    rows = [" | ".join(text(c).strip() for c in r.iter(f"{_W}tc")) for r in body.iter(f"{_W}tr")]
    return "\n".join(x for x in [*(text(p) for p in body.findall(f"{_W}p")), *rows] if x.strip())


def read_files(spark: SparkSession, path: str, most: int = 10 << 20) -> DataFrame:
    """path, hash, type, text, error of each file: errors are data."""

    def extractor(read):
        @F.pandas_udf(StringType())
        def texts(content: pd.Series) -> pd.Series:
            def one(b):
                try:
                    return None if b is None else read(bytes(b))
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                    return None

            return content.map(one)

        return texts

    own = spark.read.format("binaryFile").load(path).withColumn("type", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    plain = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    of = lambda kind: F.when(F.col("type") == kind, F.col("content"))
    text = F.when(F.col("length") > most, F.lit(None)).when(F.col("type").isin("txt", "md"), plain).when(F.col("type") == "docx", extractor(docx_text)(of("docx"))).when(F.col("type") == "pdf", extractor(pdf_text)(of("pdf")))
    error = F.when(F.col("length") > most, "file too large").when(~F.col("type").isin("txt", "md", "docx", "pdf"), "unsupported type")
    return own.select("path", F.sha2("content", 256).alias("hash"), "type", text.alias("text"), error.alias("error")).withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), F.lit("extraction failed"))))


def file_tables(files: DataFrame, size: int = 500, overlap: int = 50) -> tuple[DataFrame, DataFrame]:
    """Of ``read_files``: the chunks (path, source, hash, chunk_id, content), and a row about each file with its chunk_count."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parts = chunk(files.where("text is not null and error is null"), "path", "text", size, overlap)
    chunks = parts.join(files.select("path", "hash"), "path").select("path", name.alias("source"), "hash", "chunk_id", "content")
    counted = parts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    about = files.join(counted, "path", "left").select(F.col("path").alias("original_path"), "hash", "type", F.coalesce("n", F.lit(0)).alias("chunk_count"), F.col("error").isNull().alias("extraction_success"), F.col("error").alias("extraction_error"))
    return chunks, about
