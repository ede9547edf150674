"""Readers and writers of document collections."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.control import detected_formats

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder: name, format by extension, content. Unsupported ones stay, marked so."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.select(F.xxhash64("path").alias("file_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    return named.join(detected_formats(named.select("file_id", "name")).select("file_id", "format"), "file_id")


#: Parts of a word-processor file in reading order, and what their places are called.
PARTS = ((r"word/document\.xml", "正文"), (r"word/header(\d*)\.xml", "页眉"), (r"word/footer(\d*)\.xml", "页脚"), (r"word/footnotes\.xml", "脚注"), (r"word/endnotes\.xml", "尾注"))


def docx_blocks(content: bytes) -> list[tuple[int, str, str | None, str]]:
    """(ordinal, location, style, text) of the paragraphs of a document's body, headers, footers and notes, cells with their table, row and column. Separators of notes are left out."""
    out = []

    def para(p, where: str) -> None:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        out.append((len(out) + 1, where, style.get(f"{_W}val") if style is not None else None, text))

    def walk(parent, where: str) -> None:
        tables = 0
        for e in parent:
            if e.tag == f"{_W}p":
                para(e, where)
            elif e.tag == f"{_W}tbl":
                tables += 1
                for r, row in enumerate(e.findall(f"{_W}tr"), 1):
                    for c, cell in enumerate(row.findall(f"{_W}tc"), 1):
                        for p in cell.findall(f"{_W}p"):
                            para(p, ("" if where == "正文" else where) + f"表格{tables} 第{r}行第{c}列")

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if "word/document.xml" not in names:
            raise KeyError("no document part")
        for pattern, place in PARTS:
            found = sorted((m for n in names if (m := re.fullmatch(pattern, n))), key=lambda m: int(m[1] or 0) if m.groups() else 0)
            for m in found:
                root = ET.fromstring(z.read(m[0]))
                if place == "正文":
                    walk(root.find(f"{_W}body") if root.find(f"{_W}body") is not None else (), place)
                elif place in ("脚注", "尾注"):
                    for note in root:
                        if note.get(f"{_W}type") is None:
                            walk(note, place + (note.get(f"{_W}id") or ""))
                else:
                    walk(root, place + (m[1] or ""))
    return out


def with_docx_blocks(files: DataFrame) -> DataFrame:
    """One row a paragraph of each word-processor file (file_id, content); a file that can't be read makes one row with status invalid."""

    def run(batches):
        for b in batches:
            out = []
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(i, "ok", *x) for x in docx_blocks(c)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
                    out.append((i, "invalid", None, None, None, None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["file_id", "status", "ordinal", "location", "style", "text"])

    return files.select(F.col("file_id").cast("long"), "content").mapInArrow(run, "file_id long, status string, ordinal int, location string, style string, text string")


def serialized(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents put together again from their blocks, a blank line between paragraphs, none inside lists and tables."""
    each = F.array_sort(F.collect_list(F.struct("ordinal", "kind", "text")))
    tight = lambda k: k.isin("list", "table-cell")
    text = F.aggregate("b", F.struct(F.lit("").alias("s"), F.lit("").alias("k")), lambda a, x: F.struct(F.concat(a["s"], F.when(a["k"] == "", "").when(tight(x["kind"]) & (a["k"] == x["kind"]), "\n").otherwise("\n\n"), x["text"]).alias("s"), x["kind"].alias("k")), lambda a: a["s"])
    return blocks.groupBy(id_col).agg(each.alias("b")).select(id_col, text.alias("text"))


def front_matter(docs: DataFrame) -> DataFrame:
    """name and description of texts that begin with front matter; of equal names the last loaded wins (column prio)."""
    head = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    value = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{re.escape(k)}:\s*(.*)$", 1))
    return docs.select(value("name").alias("name"), value("description").alias("description"), "prio").filter("name <> ''").groupBy("name").agg(F.max_by("description", "prio").alias("description"))


def write_session(versions: DataFrame, path: str) -> None:
    """Append version rows, partitioned by session."""
    versions.write.mode("append").partitionBy("session_id").parquet(path)
