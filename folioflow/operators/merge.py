"""Ordered merges and page selection, as manifests: which page of which document is the n-th of the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import base_name, is_pdf
from ..schemas import VERSION
from .lists import move, number, renumber, running_total


def doc_info(pages: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, name, size, page_count, version of each document, from a row for each of its pages."""
    d = pages.groupBy(F.col(path).alias("path")).agg(F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("long").alias("size"), F.count("*").alias("page_count"))
    return d.select("path", base_name(F.col("path")).alias("name"), "size", "page_count", F.lit(VERSION).alias("version"))


def is_all(page_range: Column) -> Column:
    return F.coalesce(page_range, F.lit("")).isin("", "all")


def has_ranges(requests: DataFrame) -> DataFrame:
    """One row: whether any request is for less than a whole document."""
    return requests.agg(F.coalesce(F.bool_or(~is_all(F.col("page_range"))), F.lit(False)).alias("has_ranges"))


def normalised_range(page_range: Column) -> Column:
    return F.when(is_all(page_range), F.lit("")).otherwise(page_range)


def range_map(requests: DataFrame) -> DataFrame:
    """path, page_range: of repeated paths the last range counts. For inspection; merges keep repeats."""
    return requests.groupBy("path").agg(F.max_by(normalised_range(F.col("page_range")), "pos").alias("page_range"))


def _refuse(n: int, min_files: int, output: str) -> None:
    if not output:
        raise ValueError("no output path")
    if n < min_files:
        raise ValueError(f"at least {min_files} documents are needed")


def checked(requests: DataFrame, min_files: int = 1, output: str = "document.pdf") -> DataFrame:
    _refuse(len(requests.head(min_files)) if min_files and output else 0, min_files, output)
    return requests


def missing(requests: DataFrame, info: DataFrame) -> DataFrame:
    """Requested paths that are not there."""
    return requests.join(info, "path", "left_anti").select("path").distinct()


def enriched(requests: DataFrame, info: DataFrame, fail_fast: bool = True, only_pdf: bool = False) -> DataFrame:
    """Requests with name, size, page_count. fail_fast: an unknown document, or with only_pdf one of another name, stops
    the query; otherwise its row has an `error` and its position is closed up by `readable`."""
    d = requests.join(info.select("path", "name", "size", "page_count"), "path", "left")
    wrong = F.when(F.col("page_count").isNull(), F.concat(F.lit("no such document: "), F.coalesce("path", F.lit("null"))))
    if only_pdf:
        wrong = wrong.when(~is_pdf(F.col("path")), F.concat(F.lit("not a PDF: "), F.col("path")))
    if not fail_fast:
        return d.withColumn("error", wrong)
    return d.withColumn("page_count", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("page_count")))


def readable(requests: DataFrame) -> DataFrame:
    return renumber(requests.where("error IS NULL").drop("error"))


def manifest(requests: DataFrame, info: DataFrame, fail_fast: bool = True) -> DataFrame:
    """out_page, path, src_page: all pages of the requests in order, repeats kept."""
    d = running_total(enriched(requests, info, fail_fast).where("page_count > 0"), F.col("page_count"), "before")
    d = d.withColumn("src_page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))))
    return d.select((F.col("before") + F.col("src_page")).alias("out_page"), "path", "src_page")


def totals(requests: DataFrame, info: DataFrame) -> DataFrame:
    """One row: n_files, total_pages, total_size; zeros for an empty list."""
    d = requests.join(info.select("path", "size", "page_count"), "path", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return d.agg(F.count("*").alias("n_files"), total("page_count").alias("total_pages"), total("size").alias("total_size"))


def page_ranges(requests: DataFrame, info: DataFrame) -> DataFrame:
    """pos, path, token, low, high: the parts of each range, as written. Parts are n, n-m or all; pages count from 1; a part
    that is anything else, turned round or beyond the document stops the query."""
    d = enriched(requests, info).withColumn("_r", F.when(is_all(F.col("page_range")), F.lit("all")).otherwise(F.col("page_range")))
    d = d.select("pos", "path", "page_count", F.posexplode(F.split("_r", ",")).alias("token", "_p"))
    n = lambda k: F.regexp_extract(F.trim("_p"), r"^(\d+)(?:\s*-\s*(\d+))?$", k).try_cast("long")
    whole = F.trim("_p") == "all"
    low = F.when(whole, F.lit(1).cast("long")).otherwise(n(1))
    high = F.when(whole, F.col("page_count")).otherwise(F.coalesce(n(2), n(1)))
    d = d.withColumns({"low": low, "high": high})
    good = F.coalesce(((F.col("low") >= 1) & (F.col("low") <= F.col("high")) & (F.col("high") <= F.col("page_count"))) | (whole & (F.col("page_count") == 0)), F.lit(False))
    said = F.concat(F.lit("bad page range: "), F.col("_p"))
    stops = lambda c: F.when(good, F.col(c)).otherwise(F.raise_error(said).cast("long"))
    return d.withColumns({"low": stops("low"), "high": stops("high")}).drop("_p", "page_count")


def select_pages(requests: DataFrame, info: DataFrame) -> DataFrame:
    """out_page, path, src_page: the pages of the ranges, in the order written, repeats kept."""
    d = page_ranges(requests, info).where("high >= low")
    d = number(d, F.col("pos"), F.col("token"), pos="_n", bucket=F.floor(F.col("pos") / 10_000))
    d = running_total(d, F.col("high") - F.col("low") + 1, "before", "_n")
    d = d.withColumn("src_page", F.explode(F.sequence("low", "high")))
    return d.select((F.col("before") + F.col("src_page") - F.col("low") + 1).alias("out_page"), "path", "src_page")


def delete_pages(requests: DataFrame, info: DataFrame) -> DataFrame:
    """out_page, path, src_page: what the ranges leave of the requests' documents; an empty range deletes nothing."""
    some = requests.where(~is_all(F.col("page_range")))
    gone = page_ranges(some, info).select("pos", F.explode(F.sequence("low", "high")).alias("src_page"))
    d = running_total(enriched(requests, info).where("page_count > 0"), F.col("page_count"), "before")
    d = d.withColumn("src_page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))))
    d = d.withColumn("_n", F.col("before") + F.col("src_page") - 1).join(gone, ["pos", "src_page"], "left_anti")
    return renumber(d, "_n").select((F.col("_n") + 1).alias("out_page"), "path", "src_page")


def move_page(pages: DataFrame, i: int, j: int) -> DataFrame:
    """A manifest whose i-th page is taken out and put in as the j-th, counted from 1; unchanged if there is no such page."""
    d = move(pages.withColumn("_p", F.col("out_page") - 1), i - 1, j - 1, "_p")
    return d.select((F.col("_p") + 1).alias("out_page"), *(c for c in pages.columns if c != "out_page"))


def merge(requests: DataFrame, info: DataFrame, min_files: int = 1, output: str = "document.pdf") -> DataFrame:
    """Whole documents, or the ranges if any request has one."""
    some = F.coalesce(F.bool_or(~is_all(F.col("page_range"))), F.lit(False))
    n, ranged = requests.agg(F.count("*"), some).first()  # both guards in one pass
    _refuse(n, min_files, output)
    return select_pages(requests, info) if ranged else manifest(requests, info)


def as_requests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pos, path, page_range: whole documents in that order."""
    return spark.createDataFrame([(i, p, "all") for i, p in enumerate(paths)], "pos long, path string, page_range string")


def merge_paths(spark: SparkSession, paths: list[str] | DataFrame, info: DataFrame, min_files: int = 1, output: str = "document.pdf") -> DataFrame:
    """Whole documents by their paths: a list, or rows of pos and path. The first path that is unknown or empty stops the query."""
    if isinstance(paths, list):
        if "" in paths:
            raise ValueError("an empty path")
        paths = as_requests(spark, paths)
    d = checked(paths.select("pos", "path", F.lit("all").alias("page_range")), min_files, output)
    return manifest(d, info)


def to_requests(files: DataFrame) -> DataFrame:
    """files: pos, file_path, name, page_range, page_count, size. The same by the names that merges use."""
    return files.select("pos", F.col("file_path").alias("path"), "name", "page_range", "page_count", "size")


def merge_with_info(files: DataFrame, min_files: int = 1, output: str = "document.pdf") -> DataFrame:
    """A merge of rows that bring their own names, sizes and page counts, which are trusted; the newest of a repeated path counts."""
    d = to_requests(files)
    info = d.groupBy("path").agg(F.max_by(F.struct("name", "size", "page_count"), "pos").alias("_i")).select("path", "_i.*")
    return merge(d.select("pos", "path", "page_range"), info, min_files, output)


def paths(requests: DataFrame) -> DataFrame:
    """pos, path."""
    return requests.select("pos", "path")


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest in order; replaces what is there."""
    df.repartitionByRange("out_page").sortWithinPartitions("out_page").write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("out_page long, path string, src_page long").parquet(path)
