"""Ordered lists: rows with a dense pos from 0. Every operator keeps pos dense and unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bucket in which running totals are taken; only the buckets' totals meet in one task.
BUCKET = 10_000


def running_total(df: DataFrame, value: Column, to: str, pos: str = "pos") -> DataFrame:
    """Adds to: the sum of value over rows of smaller pos."""
    d = df.withColumn("_b", F.floor(F.col(pos) / BUCKET)).withColumn("_v", value.cast("long"))
    sums = d.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = F.sum("_v").over(Window.partitionBy("_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_w", F.coalesce(own, F.lit(0)))
    return d.join(before, "_b").withColumn(to, F.col("_o") + F.col("_w")).drop("_b", "_v", "_o", "_w")


def renumber(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Closes gaps between positions."""
    return running_total(df, F.lit(1), "_new", pos).drop(pos).withColumnRenamed("_new", pos)


def number(df: DataFrame, *order: Column, bucket: Column, pos: str = "pos") -> DataFrame:
    """Gives positions in an order. bucket: a column that follows the order and parts the rows, so that no task sorts all."""
    d = df.withColumn("_b", bucket)
    sizes = d.groupBy("_b").count()
    before = sizes.select(F.col("_b"), F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return d.join(before, "_b").withColumn(pos, (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_o", "_r")


def length(df: DataFrame) -> int:
    return df.count()


def append(df: DataFrame, batch: DataFrame, pos: str = "pos") -> DataFrame:
    """The batch, itself a list, at the end."""
    return df.unionByName(batch.withColumn(pos, F.col(pos) + F.lit(length(df))))


def prepend(df: DataFrame, batch: DataFrame, pos: str = "pos") -> DataFrame:
    return append(batch, df, pos)


def remove(df: DataFrame, key: str, value, pos: str = "pos") -> DataFrame:
    """Without the rows of that key; rows with a null key stay."""
    return renumber(df.where(~F.col(key).eqNullSafe(F.lit(value))), pos)


def find(df: DataFrame, key: str, value, pos: str = "pos") -> DataFrame:
    """The first row of that key, or none."""
    return df.where(F.col(key) == F.lit(value)).orderBy(pos).limit(1)


def update(df: DataFrame, key: str, value, **new) -> DataFrame:
    """Other values in the rows of that key."""
    hit = F.coalesce(F.col(key) == F.lit(value), F.lit(False))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.withColumns({c: F.when(hit, as_column(x)).otherwise(F.col(c)) for c, x in new.items()})


def update_all(df: DataFrame, **new) -> DataFrame:
    return df.withColumns({c: F.lit(x) for c, x in new.items()})


def swap_position(pos: Column, n: Column, i: int, step: int) -> Column:
    """Where a row goes when the i-th of n rows changes places with its neighbour; nowhere at the ends."""
    j = i + step
    possible = F.lit(j >= 0) & (F.lit(max(i, j)) < n)
    return F.when(possible & (pos == i), F.lit(j)).when(possible & (pos == j), F.lit(i)).otherwise(pos).cast("long")


def move_position(pos: Column, i: int, j: int) -> Column:
    """Where a row goes when the i-th is taken out and put in at j."""
    if i < j:
        between, step = (pos > i) & (pos <= j), -1
    else:
        between, step = (pos >= j) & (pos < i), 1
    return F.when(pos == i, F.lit(j)).when(between, pos + step).otherwise(pos).cast("long")


def swap(df: DataFrame, i: int, step: int, pos: str = "pos") -> DataFrame:
    return df.withColumn(pos, swap_position(F.col(pos), F.lit(length(df)), i, step))


def move(df: DataFrame, i: int, j: int, pos: str = "pos") -> DataFrame:
    """Unchanged if there is no i-th or j-th row."""
    n = length(df)
    return df.withColumn(pos, move_position(F.col(pos), i, j)) if 0 <= i < n and 0 <= j < n else df


def new_only(batch: DataFrame, existing: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The batch without keys that the list had before; repeats inside the batch stay."""
    return renumber(batch.join(existing.select(key), key, "left_anti"), pos)


def clear(df: DataFrame) -> DataFrame:
    return df.limit(0)


def first(df: DataFrame, pos: str = "pos") -> DataFrame:
    """The row that becomes active after a removal, or of a new batch."""
    return df.orderBy(pos).limit(1)


def page_numbers(df: DataFrame, pages: str, to: str = "page_number") -> DataFrame:
    """A row for each page from 1; none for 0, less or null."""
    return df.where(F.col(pages) > 0).withColumn(to, F.explode(F.sequence(F.lit(1).cast("long"), F.col(pages).cast("long"))))


def ordinal(pos: Column) -> Column:
    return pos + 1
