"""Readers of file trees, reports and parser output, and restartable writing."""

from __future__ import annotations

import os
import re
import struct

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.routing import category, course, excluded_dir, junk, suffix


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """All files under root: rel, course, category, ext, size and, if asked for, content. Files at the root,
    in excluded folders and junk are left out, all others counted: empty ones and those whose names Spark's own
    readers pass over (a leading "_" or "."). The folders under the root are listed in tasks, and a file is
    opened by the task that returns its content; without content no byte of a file is read."""
    store, base = _store(root)
    tops = [(f.path,) for f in store.get_file_info(pyarrow.fs.FileSelector(base)) if f.type == pyarrow.fs.FileType.Directory]

    def walk(batches):
        store, base = _store(root)
        for pdf in batches:
            for top in pdf["top"]:
                found = store.get_file_info(pyarrow.fs.FileSelector(top, recursive=True))
                rows = [(f.path, f.path[len(base.rstrip("/")) + 1 :], f.size) for f in found if f.type == pyarrow.fs.FileType.File]
                yield pd.DataFrame(rows, columns=["path", "rel", "length"]).astype({"length": "int64"})

    def read(batches):
        store, _ = _store(root)
        for pdf in batches:
            for i in range(len(pdf)):  # a file at a time: a batch of large ones need not fit together
                with store.open_input_stream(pdf["path"].iloc[i]) as f:
                    yield pdf.iloc[i : i + 1].assign(content=[f.read()])

    rows = spark.createDataFrame(tops, "top string").repartition(max(1, len(tops))).mapInPandas(walk, "path string, rel string, length long")
    rows = rows.filter((course(F.col("rel")) != "") & ~excluded_dir(F.col("rel")) & ~junk(F.col("rel")))
    rows = rows.select(
        "path", "rel", course(F.col("rel")).alias("course"), category(F.col("rel")).alias("category"),
        suffix(F.col("rel")).alias("ext"), F.col("length").alias("size"),
    )
    shape = "path string, rel string, course string, category string, ext string, size long, content binary"
    return rows.repartition("path").mapInPandas(read, shape) if content else rows


def _store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))


def of_type(files: DataFrame, *extensions: str) -> DataFrame:
    """Files with one of the extensions, in order of path."""
    return files.filter(F.col("ext").isin(*extensions)).orderBy("rel")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A CSV report: all columns text, a byte-order mark removed, empty as empty text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def typed_report(report: DataFrame) -> DataFrame:
    """A report with flagged (boolean) and pages (int) next to their texts; what does not parse is null."""
    return report.withColumns({
        "flagged": F.when(F.col("needs_llamaparse") == "True", True).when(F.col("needs_llamaparse") == "False", False),
        "page_count": F.expr("cast(try_cast(nullif(pages, '') as double) as int)"),
    })


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def content_lists(spark: SparkSession, path: str) -> DataFrame:
    """(doc, seq, block columns) of block lists; the doc is the file's name without its ending."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    doc = F.regexp_replace(F.element_at(F.split("p", "/"), -1), r"_content_list\.json$|\.json$", "")
    return raw.select(doc.alias("doc"), F.posexplode(F.from_json("value", f"array<struct<{schemas.CONTENT_BLOCK.replace(' ', ':').replace(',:', ', ')}>>")).alias("seq", "b")).select("doc", "seq", "b.*")


def middles(spark: SparkSession, path: str) -> DataFrame:
    """(doc, pdf_info); an unreadable file has null."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    doc = F.regexp_replace(F.element_at(F.split("p", "/"), -1), r"_middle\.json$|\.json$", "")
    return raw.select(doc.alias("doc"), F.from_json("value", schemas.MIDDLE)["pdf_info"].alias("pdf_info"))


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of PNG, GIF and JPEG bytes; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def images(files: DataFrame) -> DataFrame:
    """Image files (with content) with width, height and hash; unreadable ones are dropped."""

    @F.pandas_udf("struct<width: int, height: int>")
    def sizes(data: pd.Series) -> pd.DataFrame:
        found = [image_size(bytes(x)) or (None, None) for x in data]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    rows = files.withColumn("s", sizes("content")).withColumn("sha256", F.sha2("content", 256))
    return rows.filter("s.width is not null").select(*[c for c in files.columns if c != "content"], "s.width", "s.height", "sha256")


def crop_images(found: DataFrame, report: DataFrame) -> DataFrame:
    """Crop images joined to their document by the number in their path; images without one are left out."""
    number = F.regexp_extract("path", r"/(\d+)/", 1)
    return found.withColumn("idx", number).join(report.select("idx", "file", F.col("course").alias("doc_course")), "idx")


def document_index(manifest: DataFrame, report: DataFrame) -> DataFrame:
    """(file, course, quality, md_file, source_note) of documents that can be chunked: pending ones and ones
    without parsed text are left out."""
    md = report.select("file", "md_file")
    joined = manifest.join(md, "file", "left")
    path = F.when(F.col("quality") == "llamaparse_done", F.col("llamaparse_md_file")).otherwise(F.col("md_file"))
    note = F.coalesce(F.expr("nullif(docling_reasons, '')"), F.expr("nullif(note, '')"), F.lit(""))
    rows = joined.filter(~F.col("quality").startswith("pending")).withColumn("md_file", path)
    return rows.filter("coalesce(md_file, '') <> ''").select("file", "course", "quality", "md_file", note.alias("source_note"))


def parse_targets(report: DataFrame, manifest: DataFrame, per_quality: int | None = None) -> DataFrame:
    """Report rows with their manifest quality, without pending ones; in a trial the first few of each."""
    rows = report.join(manifest.select("file", "quality"), "file", "left").filter("coalesce(quality, '') not like 'pending%'")
    if per_quality is None:
        return rows
    w = Window.partitionBy("quality").orderBy("idx", "file")
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= per_quality).drop("nth")


def reparse_targets(report: DataFrame, manifest: DataFrame, priority: list[str], done: DataFrame) -> DataFrame:
    """Flagged documents of a priority course that have no successful second parse yet."""
    flagged = report.filter("needs_llamaparse = 'True'").join(manifest.select("file"), "file", "left_semi")
    return not_done(flagged.filter(F.col("course").isin(*priority)), done, "file")


def page_counts(files: DataFrame) -> DataFrame:
    """(path, pages): of PDF files (path, content) the page objects that stand in the open; null for a file that
    is no PDF or keeps its pages in compressed streams, which need a producer."""

    @F.pandas_udf("int")
    def count(data: pd.Series) -> pd.Series:
        found = [len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", bytes(x))) if bytes(x[:5]) == b"%PDF-" else 0 for x in data]
        return pd.Series([n or None for n in found], dtype="Int32")

    return files.select("path", count("content").alias("pages"))


def with_column_added(report: DataFrame, values: DataFrame, key: str, path: str) -> None:
    """Write the report with the further columns of values (key, ...) as a new version; never in place."""
    report.join(values, key, "left").write.mode("errorifexists").option("header", True).csv(path)


def not_done(targets: DataFrame, done: DataFrame, key: str, ok: str = "error is null or error = ''") -> DataFrame:
    """Targets whose key has no successful row yet."""
    return targets.join(done.filter(ok).select(key).distinct(), key, "left_anti")


def latest_attempt(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """The last attempt of each key."""
    return attempts.groupBy(key).agg(F.max_by(F.struct(*attempts.columns), F.col(order)).alias("r")).select("r.*")
