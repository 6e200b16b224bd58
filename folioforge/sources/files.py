"""Files as tables: inbox, whole texts, office documents, notes, logs; and the sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.biblio import upload_token
from folioforge.functions.text import folder_name, strip

#: What an inbox takes, the signature of old office files, name space of document XML.
INBOX = ("pdf", "docx", "hwp", "hwpx", "txt", "md")
OLE2 = bytes.fromhex("D0CF11E0")
#: Fixed value: bytes of the largest download.
DOWNLOAD_MOST = 25 * 1024 * 1024
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """``path, stem, ext, size, mtime, content, token`` of files that can be taken in, newest first."""
    return inbox_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def inbox_rows(files: DataFrame) -> DataFrame:
    """The same of rows (path, length, modificationTime, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = files.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), ext.alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", upload_token(name, F.col("content")).alias("token"))
    return rows.filter(F.col("ext").isin(*INBOX)).orderBy(F.desc("mtime"), "path")


def is_ole2(content: Column) -> Column:
    """Does a file begin as old office files do, whatever its suffix says?"""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(OLE2), F.lit(False))


def sniff(content: Column, content_type: Column, size: Column) -> Column:
    """What a downloaded answer is: ``too_large``, ``pdf``, ``text``, ``html`` (to be searched for a PDF link) or ``unsupported``."""
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.left(F.coalesce(content.cast("string"), F.lit("")), F.lit(2048)))
    page = F.regexp_replace(F.left(head, F.lit(512)), r"^\s+", "").startswith("<!doctype html") | head.contains("<html")
    return (
        F.when(size > DOWNLOAD_MOST, "too_large")
        .when(head.startswith("%pdf") | kind.contains("application/pdf"), "pdf")
        .when(kind.contains("text/plain"), "text")
        .when(kind.contains("html") | page, "html")
        .otherwise("unsupported")
    )


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, stem, text`` of whole text files."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return df.withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", ""))


def docx_text(content: bytes) -> tuple[str | None, str]:
    """(text, error): the paragraphs of a document; old formats under a new name are refused."""
    if content[:4] == OLE2:
        return None, "old_format"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, "unreadable"
    paras = ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p")]
    text = "\n".join(paras).strip()
    return (text, "") if text else (None, "empty")


def clean_converted(text: str) -> str:
    """Text of a converted file without stand-ins of pictures and rows of empty lines."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"!\[[^\]]*\]\([^)]*\)|\[(?:image|그림)[^\]]*\]", "", text)).strip()


def clean_converted_column(text: Column) -> Column:
    """The same as an expression."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)|\[(?:image|그림)[^\]]*\]", ""), r"\n{3,}", "\n\n"))


def office_texts(files: DataFrame) -> DataFrame:
    """``path, stem, text, error`` of inbox rows; what can't be read is a value, never an exception."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ext, content in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if ext == "docx":
                    out.append(docx_text(content or b""))
                elif ext in ("txt", "md"):
                    text = (content or b"").decode("utf-8", "ignore").strip()
                    out.append((text, "") if text else (None, "empty"))
                else:
                    out.append((None, "unsupported"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t and clean_converted(t) for t, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["path", "stem", "text", "error"])

    return files.select("path", "stem", "ext", "content").mapInArrow(run, "path string, stem string, text string, error string")


def notes(spark: SparkSession, path: str, nested_roots: DataFrame | None = None) -> DataFrame:
    """``path, content`` of Markdown files outside hidden folders and nested vaults."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    df = df.select(F.url_decode(F.input_file_name()).alias("path"), F.col("value").alias("content"))
    return note_candidates(df, path, nested_roots)


def note_candidates(df: DataFrame, path: str, nested_roots: DataFrame | None = None) -> DataFrame:
    """Rows with a ``path`` below ``path`` outside hidden folders and nested vaults."""
    rel = F.split(F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/")) + "/", ""), "/")
    df = df.filter(~F.exists(rel, lambda p: p.startswith(".") | p.startswith("_")))
    if nested_roots is not None:
        # The roots of nested vaults are a handful; the folders of each path join them by equality.
        folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
        inside = df.select("path", F.explode(folders).alias("root")).join(nested_roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
        df = df.join(inside, "path", "left_anti")
    return df


def vaults(spark: SparkSession, path: str) -> DataFrame:
    """``path, ts`` of a vault registry, newest first."""
    return vault_rows(spark.read.text(path, wholetext=True), "value")


def vault_rows(registries: DataFrame, value: str) -> DataFrame:
    """The same of rows with a registry's JSON."""
    m = F.from_json(value, "vaults map<string, struct<path: string, ts: long>>")["vaults"]
    return registries.select(F.explode(F.map_values(m)).alias("v")).select("v.path", "v.ts").orderBy(F.desc("ts"))


def log_tail(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The last n lines by their time stamps."""
    return log_lines(spark.read.text(path), "value", n)


def log_lines(lines: DataFrame, value: str, n: int = 20) -> DataFrame:
    """The same of rows with a line each."""
    rows = lines.select(F.regexp_extract(value, r"^\[([0-9: \-]{19})\]", 1).alias("at"), F.col(value).alias("line"))
    return rows.filter("at <> ''").orderBy(F.desc("at"), F.desc("line")).limit(n)


def write_chapters(chapters: DataFrame, path: str, book: str = "stem") -> None:
    """Chapters by book; a book that is written again replaces its folder."""
    spark = chapters.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        chapters.withColumn("book", folder_name(F.col(book))).write.mode("overwrite").partitionBy("book").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_notes(rendered: DataFrame, path: str, by: str) -> None:
    """Rendered notes as text by a folder column, committed as a whole."""
    rendered.write.mode("overwrite").partitionBy(by).parquet(path)


def append_done(done: DataFrame, path: str) -> None:
    done.select("name").write.mode("append").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
