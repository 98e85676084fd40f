"""Text spans of a page: boxes relative to the page's, with defaults for type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import or_default


def relative_spans(spans: DataFrame) -> DataFrame:
    """spans: id, text, left, top, width, height, parent_left, parent_top, font_size, font_family, color."""
    return spans.select(
        "id", "text", (F.col("left") - F.col("parent_left")).alias("x"), (F.col("top") - F.col("parent_top")).alias("y"), "width", "height",
        or_default(F.col("font_size"), 12.0).alias("font_size"), or_default(F.col("font_family"), "Helvetica").alias("font_family"),
        or_default(F.col("color"), "#000000").alias("color"),
    )


def page_texts(spans: DataFrame) -> DataFrame:
    """spans: path, page, pos, text. path, page, text: a page's spans in order, parted by spaces; null and empty ones leave nothing."""
    order = F.sort_array(F.collect_list(F.struct("pos", "text")))  # the spans of one page
    return spans.where("text != ''").groupBy("path", "page").agg(F.array_join(order["text"], " ").alias("text"))


def document_texts(pages: DataFrame) -> DataFrame:
    """pages: path, page, text. path, pages, text: a document's pages in order, parted by line breaks."""
    order = F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))  # the pages of one document
    return pages.groupBy("path").agg(F.count("*").alias("pages"), F.array_join(order["text"], "\n").alias("text"))
