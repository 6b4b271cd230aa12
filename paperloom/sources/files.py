"""Files and uploads as rows, and their text."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import EXTENSIONS, WHITE_SPACE, accepted, basename, is_blank, suffix
from paperloom.sources.folders import FolderSource

#: What marks a page, and what stands for a PDF without text or one that cannot be read.
PAGE_MARK, NO_TEXT, BROKEN = "[Page {}]\n", "[PDF 텍스트 없음: {}]", "[PDF: {}]"
WORD_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def folder(spark: SparkSession, path: str) -> DataFrame:
    """path, directory, name, length, content of all files of an accepted kind under a folder, of any size that a row can hold; those whose names begin with _ or . too. Tasks list them and read them."""
    spark.dataSource.register(FolderSource)
    files = spark.read.format(FolderSource.name()).option("suffixes", ",".join(EXTENSIONS)).load(path)
    return files.select("path", "directory", "name", "length", "content").where(accepted(F.col("name")))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """As folder, in the order of folders, then names."""
    return folder(spark, root).orderBy("directory", "name")


def visible_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length, content by Spark's own listing, for stores that only Spark reads; it leaves out names that begin with _ or ."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", basename(F.col("path")).alias("name"), "length", "content").where(accepted(F.col("name")))


def single_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", basename(F.col("path")).alias("name"), "length", "content")


def uploads(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(n, n, len(b), bytearray(b)) for n, b in items], "path string, name string, length long, content binary")


def word_paragraphs(content: bytes) -> str:
    """Paragraphs of a word-processing package that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_TEXT}body")
    out = []
    for p in body.findall(f"{WORD_TEXT}p"):
        mark = {f"{WORD_TEXT}tab": "\t", f"{WORD_TEXT}br": "\n", f"{WORD_TEXT}cr": "\n"}
        text = "".join((x.text or "") if x.tag == f"{WORD_TEXT}t" else mark.get(x.tag, "") for x in p.iter())
        if text.strip(WHITE_SPACE):
            out.append(text)
    return "\n".join(out)


_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:[^\]]*)\]\s*TJ|T\*|Td|TD|'|ET")
_STRING = re.compile(rb"\((?P<s>(?:\\.|[^\\()])*)\)")


def pdf_pages(content: bytes) -> list[str]:
    """Text that pages show as plain strings. Without a PDF library this reads uncompressed objects and Flate streams with simple fonts; a file of another make raises ValueError."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(\d+)\s+0\s+obj\b(.*?)\bendobj", content)}
    pages = [n for n, o in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", o)]
    if not pages:
        raise ValueError("no pages found")
    out = []
    for n in pages:
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+0\s+R)", objects[n])
        text = []
        for ref in re.findall(rb"(\d+)\s+0\s+R", found[1]) if found else ():
            part = re.search(rb"(?s)^(.*?)stream\r?\n(.*?)\r?\n?endstream", objects.get(int(ref), b""))
            if not part:
                continue
            data = zlib.decompress(part[2]) if b"/FlateDecode" in part[1] else part[2]
            text.append(_shown_text(data))
        out.append("\n".join(t for t in text if t))
    return out


def _shown_text(data: bytes) -> str:
    out: list[str] = []
    for m in _SHOWN.finditer(data):
        token = m[0]
        if token in (b"T*", b"Td", b"TD", b"'", b"ET"):
            if out and out[-1] != "\n":
                out.append("\n")
            continue
        for s in _STRING.finditer(token):
            plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(e[1], e[1]), s["s"])
            out.append(plain.decode("latin-1"))
    return "".join(out).strip("\n")


def file_text(content: bytes, name: str, kind: str, mode: str = "ingest", pages: Callable[[bytes], list[str]] = pdf_pages) -> str:
    """Text of a file by the kind of its name. Word files that cannot be read are taken as UTF-8; of PDFs the ingest mode marks
    pages and leaves out blank ones, the analyze mode joins all; one that cannot be read gives a placeholder."""
    if kind in (".docx", ".doc"):
        try:
            return word_paragraphs(content)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
            pass
    if kind == ".pdf":
        try:
            found = pages(content)
        except (ValueError, zlib.error):
            return BROKEN.format(name)
        if mode == "analyze":
            return "\n".join(found)
        marked = [PAGE_MARK.format(i + 1) + t for i, t in enumerate(found) if t.strip(WHITE_SPACE)]
        return "\n\n".join(marked) if marked else NO_TEXT.format(name)
    return content.decode("utf-8", errors="replace")


def extracted(files: DataFrame, mode: str = "ingest") -> DataFrame:
    """files (path, name, content, ...) with text in place of content. Plain text is decoded by Spark; only word and PDF files go to Python."""
    kind = suffix(F.col("name"))
    rows = files.withColumn("kind", kind)
    others = [c for c in files.columns if c != "content"]
    plain = rows.where(~F.col("kind").isin(".pdf", ".docx", ".doc")).select(*others, F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [file_text(bytes(c), n, k, mode) for c, n, k in zip(batch["content"], batch["name"], batch["kind"], strict=True)]
            yield batch[[*others, "text"]]

    schema = T.StructType([*[files.schema[c] for c in others], T.StructField("text", T.StringType())])
    return plain.union(rows.where(F.col("kind").isin(".pdf", ".docx", ".doc")).mapInPandas(run, schema))


def with_text(files: DataFrame) -> DataFrame:
    """Files whose text is blank give no chunk and do not count."""
    return files.where(~is_blank(F.coalesce("text", F.lit(""))))
