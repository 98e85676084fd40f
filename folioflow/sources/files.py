"""Documents as files: listings, page counts and data URLs."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import base_name, data_url, is_pdf
from ..schemas import VERSION

_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_COUNT = re.compile(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)


def page_count(data: bytes | None) -> int | None:
    """Pages of a PDF's bytes; null if they are none. Page objects are counted, also inside compressed object streams; where
    earlier versions of objects remain after updates, the page tree's own count is taken."""
    if not data or b"%PDF-" not in data[:1024]:
        return None
    parts = [data]
    for m in _STREAM.finditer(data):
        if b"/ObjStm" in data[max(0, m.start() - 400) : m.start()]:
            try:
                parts.append(zlib.decompress(m[1]))
            except zlib.error:
                continue
    pages = sum(len(_PAGE.findall(p)) for p in parts)
    told = [int(a or b) for p in parts for a, b in _COUNT.findall(p)]
    return max(told) if told and (pages == 0 or max(told) < pages) else (pages or None)


def _page_counts(content: pd.Series) -> pd.Series:
    return content.map(page_count).astype("Int64")


def listing(spark: SparkSession, *paths: str, only_pdf: bool = False) -> DataFrame:
    """path, name, last_modified, size of files. Bytes are not read. Files without bytes are not listed by Spark."""
    d = spark.read.format("binaryFile").load(list(paths))
    d = d.where(is_pdf(F.col("path"))) if only_pdf else d
    return d.select("path", base_name(F.col("path")).alias("name"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size"))


def picked(spark: SparkSession, *paths: str) -> DataFrame:
    """Files chosen one by one: whatever they are, as the filter of the choice only advises. See `as_files`."""
    return as_files(listing(spark, *paths), picked=True)


def dropped(spark: SparkSession, *paths: str) -> DataFrame:
    """Files dropped on the list: whatever they are."""
    return as_files(listing(spark, *paths), picked=False)


def chosen(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of the plain input that stands in for the chooser: PDFs alone."""
    return as_files(listing(spark, *paths, only_pdf=True), picked=False)


def as_files(listed: DataFrame, picked: bool) -> DataFrame:
    """path, name, size, view_uri, picked: files as the list of documents takes them. An id of the content stands for a dropped file's bytes."""
    uri = F.col("path") if picked else F.concat(F.lit("blob:"), F.sha2("path", 256))
    return listed.select("path", "name", "size", uri.alias("view_uri"), F.lit(picked).alias("picked"))


def file_info(spark: SparkSession, *paths: str) -> DataFrame:
    """Files as rows of the recents list: path, name, last_opened (when it was changed last), size, page_count (0: not read yet)."""
    d = listing(spark, *paths)
    return d.select("path", "name", F.col("last_modified").alias("last_opened"), "size", F.lit(0).cast("long").alias("page_count"))


def existing(requests: DataFrame, listed: DataFrame) -> DataFrame:
    """requests with `exists`: whether the path is among the listed ones."""
    known = listed.select("path").distinct().withColumn("_e", F.lit(True))
    return requests.join(known, "path", "left").withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_e")


def documents(spark: SparkSession, *paths: str, only_pdf: bool = True) -> DataFrame:
    """path, name, size, page_count, version, error of files; a file that cannot be read has an error, and the others go on."""
    d = spark.read.format("binaryFile").load(list(paths))
    d = d.where(is_pdf(F.col("path"))) if only_pdf else d
    d = d.select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.pandas_udf(_page_counts, "bigint")("content").alias("page_count"))
    return d.select("*", F.lit(VERSION).alias("version"), F.when(F.col("page_count").isNull(), F.lit("not a readable PDF")).alias("error"))


def pdf_info(spark: SparkSession, *paths: str) -> DataFrame:
    """path, name, size, page_count, version of PDFs; one that cannot be read stops the query."""
    d = documents(spark, *paths)
    wrong = F.raise_error(F.concat(F.col("error"), F.lit(": "), F.col("path"))).cast("long")
    return d.select("path", "name", "size", F.when(F.col("error").isNotNull(), wrong).otherwise(F.col("page_count")).alias("page_count"), "version")


def validity(docs: DataFrame) -> DataFrame:
    """One row: whether all documents can be read; no documents are valid."""
    return docs.agg(F.coalesce(F.bool_and(F.col("error").isNull()), F.lit(True)).alias("valid"))


def all_valid(docs: DataFrame) -> bool:
    return validity(docs).first()[0]


def data_urls(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", data_url(F.col("content")).alias("url"))


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that do not exist, in order."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, a in zip(paths, at, strict=True) if not a.getFileSystem(conf).exists(a)]


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """The merge of one document: a copy, its folder made first."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    b.getFileSystem(conf).mkdirs(b.getParent())
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def blank_pdf(pages: int) -> bytes:
    """A PDF of so many empty pages."""
    kids = b" ".join(b"%d 0 R" % (i + 3) for i in range(pages))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, pages)]
    parts += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] >>"] * pages
    data, at = b"%PDF-1.4\n", []
    for i, part in enumerate(parts):
        at.append(len(data))
        data += b"%d 0 obj\n%s\nendobj\n" % (i + 1, part)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    end = b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n"
    return data + end % (len(parts) + 1, table, len(parts) + 1, len(data))


def _writing(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{folder}/{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(content or b"")
                fs.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    return run


def write_files(files: DataFrame, folder: str) -> int:
    """files: name, content (bytes), names distinct. A file for each row, whole or not at all; how many there are."""
    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(_writing(folder), "name string").count()
