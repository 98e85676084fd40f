"""The notification log: read state, expiry of one type, the newest few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TOASTS_SHOWN, TTL_SECONDS


def visible(log: DataFrame, now: Column, seconds: int = TTL_SECONDS) -> DataFrame:
    """Without `success` rows of that age or more."""
    old = (F.col("type") == "success") & (F.col("ts") <= now - F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)")))
    return log.where(~F.coalesce(old, F.lit(False)))


def unread(log: DataFrame) -> DataFrame:
    """One row: rows that were not read; a missing state counts as unread."""
    return log.agg(F.count_if(~F.coalesce("read", F.lit(False))).alias("unread"))


def toasts(log: DataFrame, shown: int = TOASTS_SHOWN) -> DataFrame:
    return log.orderBy(F.desc("ts"), "id").limit(shown)


def mark_all_read(log: DataFrame) -> DataFrame:
    return log.withColumn("read", F.lit(True))


def mark_read(log: DataFrame, id_: str) -> DataFrame:
    return log.withColumn("read", F.when(F.col("id") == id_, F.lit(True)).otherwise(F.col("read")))


def folded(commands: DataFrame) -> DataFrame:
    """commands: seq, command (add, mark, clear with an id; mark_all, clear_all), id. What is there after all of them: id, seq
    of its adding, read. Two additions of one id replace each other."""
    last = lambda c: F.max(F.when(F.col("command") == c, F.col("seq")))
    marked, cleared = commands.agg(last("mark_all"), last("clear_all")).first()
    d = commands.where("id IS NOT NULL").groupBy("id").agg(last("add").alias("seq"), last("mark").alias("m"), last("clear").alias("c"))
    after = lambda c, other: F.coalesce(c, F.lit(-(2**62))) > other
    gone = after(F.col("c"), F.col("seq")) | after(F.lit(cleared).cast("long"), F.col("seq"))
    read = after(F.col("m"), F.col("seq")) | after(F.lit(marked).cast("long"), F.col("seq"))
    return d.where(F.col("seq").isNotNull() & ~gone).select("id", "seq", read.alias("read"))
