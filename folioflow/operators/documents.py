"""The list of loaded documents: adding files, what can be merged of it, and the guards of its tools.

Rows: pos, id, name, pages, size, view_uri, original_path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lists import append, renumber

#: What is taken for the pages of a document that was not opened yet.
PLACEHOLDER_PAGES = 1


def new_id(*key: Column) -> Column:
    """An id that follows from a key, so that a repeated task gives the same; with the moment of adding in the key it is new."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("")) for k in key)), 256).substr(1, 32)


def loaded(files: DataFrame, batch: str) -> DataFrame:
    """files: pos, path, name, size, view_uri (null: unreadable), picked. The rows they become: unreadable ones are left out, and
    only picked ones have an original path, as dropped ones are known by their content alone. batch makes the ids new."""
    d = renumber(files.where("view_uri IS NOT NULL"))
    return d.select(
        "pos", new_id(F.lit(batch), F.col("pos"), F.col("path")).alias("id"), "name", F.lit(PLACEHOLDER_PAGES).cast("long").alias("pages"), "size", "view_uri",
        F.when(F.col("picked"), F.col("path")).alias("original_path"),
    )


def add_documents(current: DataFrame, files: DataFrame, batch: str, active: str | None = None) -> tuple[DataFrame, str | None]:
    """The list with the files at its end, and the id of the active document: the one before, else the first of the files."""
    new = loaded(files, batch)
    if active is None:
        first = new.where("pos = 0").select("id").head()
        active = first[0] if first else None
    return append(current, new), active


def page_counts_written(current: DataFrame, info: DataFrame) -> DataFrame:
    """info: path, page_count. Rows whose document was opened have its true number of pages; the others keep what they have."""
    found = info.select(F.col("path").alias("original_path"), F.col("page_count").alias("_n"))
    return current.join(found, "original_path", "left").withColumn("pages", F.coalesce("_n", "pages")).drop("_n").select(*current.columns)


def with_original_path(current: DataFrame) -> DataFrame:
    """Documents without a path of their own cannot be merged."""
    return current.where("original_path IS NOT NULL AND original_path != ''")


def to_merge_rows(current: DataFrame) -> DataFrame:
    """pos, id, path, name, size, page_count."""
    return current.select("pos", "id", F.col("original_path").alias("path"), "name", "size", F.col("pages").alias("page_count"))


def dialog_list(current: DataFrame) -> DataFrame:
    """The working list of a merge: the documents that have a path, numbered anew."""
    return renumber(to_merge_rows(with_original_path(current)))


def require_open(current: DataFrame, active: str | None, action: str) -> DataFrame:
    """The active document; an error if there is none."""
    d = current.where(F.col("id") == F.lit(active)).limit(1)
    if active is None or not d.head(1):
        raise ValueError(f"open a document first to {action}")
    return d


def snapshot(df: DataFrame) -> DataFrame:
    """What the list is now; DataFrames do not change, so it is the list itself."""
    return df

