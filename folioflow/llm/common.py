"""What the operators share: tables, the shared scratch folder, broadcasts behind a size check."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: white space of words, as a Java and as a RE2 character class.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"

#: Rows of a lookup table, and bytes of its values, up to which it may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Rows that a task writes at least, where their number is known.
TASK_ROWS = 100_000
#: A hot key's rows are dealt over so many tasks where joins shuffle.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a folder of this machine, but only if all tasks run on it, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A folder of one run in the shared folder. Tables written here cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/folioflow/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
        """rows: at least so many as df can have, where that is known; small tables are then not dealt to many files."""
        if rows is not None:
            df = df.coalesce(max(1, rows // TASK_ROWS))
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Removes all tables but these: what no result reads any more."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)

    def drop(self, name: str | None = None) -> None:
        """Removes one table, or the folder. At exit the session may be gone; the folder then stays."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:
            if name:
                raise


def small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has at most that many rows, and BROADCAST_BYTES of values. Both are summed where the rows lie; no rows are moved."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = reduce(lambda a, c: a + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)), df.columns, F.lit(0).cast("long"))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and total <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint behind a check of the size; beyond it the planner shuffles."""
    return F.broadcast(df) if small(df, rows) else df


def looked_up(df: DataFrame, lookup: DataFrame, on: list[str], *spread: str, how: str = "inner") -> DataFrame:
    """df joined to a table of distinct keys: broadcast behind a check of its size; beyond it both are shuffled, and as one
    key may hold much of df, its rows are dealt over SALTS tasks by the columns of spread, and each key is sent to all of them.
    A key with a null finds nothing."""
    if small(lookup):
        return df.join(F.broadcast(lookup), on, how)
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def white_words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space, in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE + "+"))
