"""Where an application keeps its own files: one folder, made when it is first asked for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: The session's setting for the folder; without it a folder under spark.checkpoint.dir is taken.
SETTING = "spark.folioflow.store"
#: Fixed value.
RECENTS_FILE = "recent.json"


def location(spark: SparkSession, folder: str = "") -> str:
    """The folder named, else the session's; made if it is not there. On a cluster one of both settings must name a shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = folder or spark.conf.get(SETTING, None) or (f"{shared.rstrip('/')}/folioflow-store" if shared else "")
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"{SETTING} or spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='folioflow-store-')}"
        spark.conf.set(SETTING, root)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return root


def recents_file(spark: SparkSession, folder: str = "") -> str:
    return f"{location(spark, folder)}/{RECENTS_FILE}"
