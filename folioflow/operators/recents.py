"""The most-recently-used list: one row a path, newest first, cut to a fixed number."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import RECENT, RECENTS_KEPT


def recents(opened: DataFrame, kept: int = RECENTS_KEPT, *ties: str) -> DataFrame:
    """opened: path, last_opened and other columns, a row for each time. The newest row of each path, newest first, with pos."""
    others = [c for c in opened.columns if c != "path"]
    key = ["last_opened", *ties]
    latest = F.max(F.struct(*key, *(c for c in others if c not in key))).alias("r")
    d = opened.groupBy("path").agg(latest).select("path", *(F.col(f"r.{c}").alias(c) for c in others))
    order = [*(F.desc(k) for k in key), F.asc("path")]
    d = d.orderBy(*order).limit(kept)
    return d.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))  # at most `kept` rows


def add(current: DataFrame, new: DataFrame, kept: int = RECENTS_KEPT, *ties: str) -> DataFrame:
    """The list after one more opening: the path's old row goes, the new one comes first."""
    return recents(current.drop("pos").unionByName(new), kept, *ties)


def remove(current: DataFrame, path: str, *ties: str) -> DataFrame:
    """The list without a path; numbered anew."""
    return recents(current.drop("pos").where(F.col("path") != path), RECENTS_KEPT, *ties)


def export_json(current: DataFrame, kept: int = RECENTS_KEPT) -> str:
    """An array of at most `kept` objects, indented by two."""
    names = {"path": "path", "name": "name", "last_opened": "lastOpened", "size": "size", "page_count": "pageCount"}
    rows = current.orderBy("pos").limit(kept).withColumn("last_opened", F.date_format("last_opened", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).collect()
    return json.dumps([{names[c]: r[c] for c in names} for r in rows], indent=2)


def save_json(current: DataFrame, path: str, kept: int = RECENTS_KEPT) -> None:
    """Replaces the file at once: written beside it under another name, then moved."""
    spark = current.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs, beside = at.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    data = export_json(current, kept).encode()
    fs.mkdirs(at.getParent())
    out = fs.create(beside, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"cannot write {path}")


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """The list of a JSON file; empty if there is none. What is no such array raises."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RECENT + ", pos BIGINT")
    raw = spark.read.schema("path STRING, name STRING, lastOpened TIMESTAMP, size BIGINT, pageCount BIGINT").json(path, multiLine=True, mode="FAILFAST")
    d = raw.select("path", "name", F.col("lastOpened").alias("last_opened"), "size", F.col("pageCount").alias("page_count"))
    return recents(d)
