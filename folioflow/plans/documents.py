"""Queries over files and the list of loaded documents, registered with those of the catalogue.

Files are made from whole tables in the store's folder: a conversation is a document, with its texts as bytes, or with a
blank page for each turn.
"""

from __future__ import annotations

import atexit
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import lists as L
from ..operators import merge as M
from ..operators import recents as R
from ..operators.spans import document_texts, page_texts
from ..schemas import RECENTS_KEPT
from ..sources import files, store
from ..streaming import notifications as T
from .catalogue import SQL_INFO, SQL_REQUESTS, _info, _list, _opened, _requests, _table, query


def _folder(spark: SparkSession) -> str:
    """A folder of one call; it goes when the process ends."""
    root = f"{store.location(spark)}/{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone
            pass

    atexit.register(drop)
    return root


def _texts(spark: SparkSession, d: str) -> str:
    """A folder with a file for each conversation: its texts; a third are no PDFs by name."""
    n = F.col("conv_id") % 3
    name = F.concat(F.col("conv_id").cast("string"), F.when(n == 0, F.lit(".txt")).when(n == 1, F.lit(".PDF")).otherwise(F.lit(".pdf")))
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    t = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns["text"], "").alias("text"))
    root = _folder(spark)
    files.write_files(t.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), root)
    return root


_FILE_NAME = "conv_id || CASE conv_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END"
_SQL_FILES = f"(SELECT {_FILE_NAME} AS name, size, conv_id FROM {SQL_INFO} WHERE size > 0)"


def _pdfs(spark: SparkSession, d: str, broken: bool) -> str:
    """A folder with a PDF for each conversation, a page for each turn; with broken, each seventh is none."""
    make = F.pandas_udf(lambda n: pd.Series([files.blank_pdf(int(x)) for x in n]), "binary")
    t = _table(spark, d, "conversations").groupBy("conv_id").count()
    content = F.when((F.col("conv_id") % 7 == 0) & F.lit(broken), F.encode(F.lit("no PDF"), "UTF-8")).otherwise(make("count"))
    root = _folder(spark)
    files.write_files(t.select(F.concat(F.col("conv_id").cast("string"), F.lit(".pdf")).alias("name"), content.alias("content")), root)
    return root


@query("files_picked", f"SELECT name, size, true AS picked, true AS by_path FROM {_SQL_FILES}")
def _(spark, d):
    return files.picked(spark, _texts(spark, d)).select("name", "size", "picked", (F.col("view_uri") == F.col("path")).alias("by_path"))


@query("files_dropped", f"SELECT name, size, false AS picked, true AS by_content FROM {_SQL_FILES}")
def _(spark, d):
    return files.dropped(spark, _texts(spark, d)).select("name", "size", "picked", F.col("view_uri").startswith("blob:").alias("by_content"))


@query("files_chosen", f"SELECT name, size FROM {_SQL_FILES} WHERE conv_id % 3 <> 0")
def _(spark, d):
    return files.chosen(spark, _texts(spark, d)).select("name", "size")


@query("file_info", f"SELECT name, size, 0::BIGINT AS page_count, true AS dated FROM {_SQL_FILES}")
def _(spark, d):
    return files.file_info(spark, _texts(spark, d)).select("name", "size", "page_count", F.col("last_opened").isNotNull().alias("dated"))


@query("files_exist", f"SELECT name, true AS exists FROM {_SQL_FILES} UNION ALL SELECT 'none-' || name, false FROM {_SQL_FILES}")
def _(spark, d):
    listed = files.listing(spark, _texts(spark, d))
    asked = listed.select("path", "name").unionByName(listed.select(F.concat("path", F.lit("-none")).alias("path"), F.concat(F.lit("none-"), "name").alias("name")))
    return files.existing(asked, listed).select("name", "exists")


@query("file_data_urls", f"""SELECT {_FILE_NAME} AS name, 'data:application/pdf;base64,' || base64(encode(string_agg(coalesce(text, ''), '' ORDER BY turn))) AS url
    FROM conversations GROUP BY conv_id HAVING sum(strlen(coalesce(text, ''))) > 0""")  # fmt: skip
def _(spark, d):
    from ..functions.scalars import base_name

    return files.data_urls(spark, _texts(spark, d)).select(base_name(F.col("path")).alias("name"), "url")


@query("pdf_page_counts", f"SELECT name, CASE WHEN conv_id % 7 <> 0 THEN page_count END AS page_count, conv_id % 7 = 0 AS failed FROM {SQL_INFO}")
def _(spark, d):
    return files.documents(spark, _pdfs(spark, d, True)).select("name", "page_count", F.col("error").isNotNull().alias("failed"))


@query("pdf_info", f"SELECT name, page_count, version FROM {SQL_INFO}")
def _(spark, d):
    return files.pdf_info(spark, _pdfs(spark, d, False)).select("name", "page_count", "version")


@query("pdf_validity", f"SELECT count(*) = 0 AS valid FROM {SQL_INFO} WHERE conv_id % 7 = 0")
def _(spark, d):
    return files.validity(files.documents(spark, _pdfs(spark, d, True)))


@query("file_copied", f"SELECT 'copy.pdf' AS name, page_count FROM {SQL_INFO} ORDER BY conv_id DESC LIMIT 1")
def _(spark, d):
    root = _pdfs(spark, d, False)
    last = _table(spark, d, "conversations").agg(F.max("conv_id")).first()[0]
    files.copy_file(spark, f"{root}/{last}.pdf", f"{root}/copies/copy.pdf")
    return files.documents(spark, f"{root}/copies").select("name", "page_count")


@query("store_location", "SELECT true AS there, 'recent.json' AS file")
def _(spark, d):
    root = store.location(spark)
    there = not files.missing_paths(spark, [root])
    return spark.createDataFrame([(there, store.recents_file(spark).rsplit("/", 1)[-1])], "there boolean, file string")


# recents as a file and over a stream


def _recent(spark: SparkSession, d: str) -> DataFrame:
    return _opened(spark, d).select(
        "path", F.substring_index("path", "/", -1).alias("name"), F.col("last_opened").cast("timestamp").alias("last_opened"), F.length("path").cast("long").alias("size"),
        F.lit(0).cast("long").alias("page_count"),
    )


_CLOCK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_SQL_RECENT = """SELECT path, parse_filename(path) AS name, strftime(last_opened, '%Y-%m-%d %H:%M:%S.%f') AS last_opened, length(path) AS size, 0::BIGINT AS page_count,
    row_number() OVER (ORDER BY last_opened DESC, path) - 1 AS pos
    FROM (SELECT 'users/' || user_id || '.pdf' AS path, max(ts) AS last_opened FROM events GROUP BY user_id)"""


@query("recents_saved", f"{_SQL_RECENT} ORDER BY pos LIMIT {RECENTS_KEPT}")
def _(spark, d):
    path = f"{_folder(spark)}/{store.RECENTS_FILE}"
    R.save_json(R.recents(_recent(spark, d)), path)
    return R.load_json(spark, path).withColumn("last_opened", F.date_format("last_opened", _CLOCK))


@query("recents_streamed", f"{_SQL_RECENT} ORDER BY pos LIMIT {RECENTS_KEPT}")
def _(spark, d):
    rows, root = _recent(spark, d), _folder(spark)
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    T.keep_recents(stream, f"{root}/lists").trigger(availableNow=True).option("checkpointLocation", f"{root}/progress").start().awaitTermination()
    return T.latest(spark, f"{root}/lists").withColumn("last_opened", F.date_format("last_opened", _CLOCK))


@query("recents_add", f"{_SQL_RECENT} ORDER BY pos LIMIT {RECENTS_KEPT}")
def _(spark, d):
    rows, half = _recent(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")
    added = R.add(R.recents(rows.where(F.col("last_opened") < half)), rows.where(F.col("last_opened") >= half))
    return added.withColumn("last_opened", F.date_format("last_opened", _CLOCK))


@query("recents_remove_newest", f"SELECT path, pos - 1 AS pos FROM ({_SQL_RECENT}) WHERE pos BETWEEN 1 AND {RECENTS_KEPT - 1}")
def _(spark, d):
    current = R.recents(_recent(spark, d))
    return R.remove(current, current.where("pos = 0").first()["path"]).select("path", "pos")


# merges by paths, by rows of information, and their guards


@query("request_paths", f"SELECT pos, path FROM {SQL_REQUESTS}")
def _(spark, d):
    return M.paths(_requests(spark, d))


@query("requests_renamed", f"SELECT pos, path, conv_id || '.pdf' AS name, page_range, page_count, size FROM {SQL_REQUESTS}")
def _(spark, d):
    return M.to_requests(_with_info(spark, d))


def _with_info(spark: SparkSession, d: str) -> DataFrame:
    r = _requests(spark, d).join(_info(spark, d), "path")
    return r.select("pos", F.col("path").alias("file_path"), "name", "page_range", "page_count", "size")


_SQL_WHOLE = f"SELECT row_number() OVER (ORDER BY pos, t.turn) AS out_page, path, t.turn + 1 AS src_page FROM {SQL_REQUESTS} r JOIN conversations t USING (conv_id)"


@query("merge_paths", _SQL_WHOLE)
def _(spark, d):
    return M.merge_paths(spark, M.paths(_requests(spark, d)), _info(spark, d))


@query("merge_with_info", f"""SELECT row_number() OVER (ORDER BY pos, t.turn) AS out_page, path, t.turn + 1 AS src_page
    FROM {SQL_REQUESTS} r JOIN conversations t USING (conv_id)""")  # fmt: skip
def _(spark, d):
    return M.merge_with_info(_with_info(spark, d).withColumn("page_range", F.lit("")))


@query("merge_whole", _SQL_WHOLE)
def _(spark, d):
    return M.merge(_requests(spark, d).withColumn("page_range", F.lit("all")), _info(spark, d), min_files=2)


@query("enriched", f"SELECT pos, path, page_range, conv_id || '.pdf' AS name, size, page_count FROM {SQL_REQUESTS}")
def _(spark, d):
    return M.enriched(_requests(spark, d), _info(spark, d), only_pdf=True)


@query("merge_written", _SQL_WHOLE)
def _(spark, d):
    path = f"{_folder(spark)}/merged"
    M.write_manifest(M.manifest(_requests(spark, d), _info(spark, d)), path)
    return M.read_manifest(spark, path)


@query("merged_page_moved", f"""SELECT CASE WHEN out_page = 2 THEN 9 WHEN out_page > 2 AND out_page <= 9 THEN out_page - 1 ELSE out_page END AS out_page, path, src_page
    FROM ({_SQL_WHOLE})""")  # fmt: skip
def _(spark, d):
    return M.move_page(M.manifest(_requests(spark, d), _info(spark, d)), 2, 9)


@query("document_texts", """SELECT conv_id AS path, count(*) AS pages, string_agg(text, chr(10) ORDER BY page) AS text FROM
    (SELECT conv_id, turn + 1 AS page, concat_ws(' ', nullif(role, ''), nullif(text, '')) AS text FROM conversations) WHERE text <> '' GROUP BY conv_id""")  # fmt: skip
def _(spark, d):
    t = _table(spark, d, "conversations")
    role = t.select(F.col("conv_id").alias("path"), (F.col("turn") + 1).alias("page"), F.lit(0).alias("pos"), F.col("role").alias("text"))
    said = t.select(F.col("conv_id").alias("path"), (F.col("turn") + 1).alias("page"), F.lit(1).alias("pos"), "text")
    return document_texts(page_texts(role.unionByName(said)))


@query("guards", "SELECT * FROM (VALUES ('no files', true), ('no output', true), ('one of two', true), ('empty path', true), ('nothing open', true), ('two files', false)) AS t(guard, refused)")
def _(spark, d):
    r, info = _requests(spark, d), _info(spark, d)
    one = r.where("pos = 0")
    calls = {
        "no files": lambda: M.merge(L.clear(r), info), "no output": lambda: M.checked(r, output=""), "one of two": lambda: M.merge(one, info, min_files=2),
        "empty path": lambda: M.merge_paths(spark, [""], info), "nothing open": lambda: D.require_open(_loaded(spark, d), None, "merge"), "two files": lambda: M.checked(r, 2),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "guard string, refused boolean")


# the list of loaded documents: pages, each fifth unreadable, each third dropped


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    t = _table(spark, d, "pages").select(
        n.alias("key"), F.concat(F.lit("pages/"), n.cast("string"), F.lit(".pdf")).alias("path"), F.concat(n.cast("string"), F.lit(".pdf")).alias("name"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"), F.when(n % 5 != 0, F.concat(F.lit("data:"), n.cast("string"))).alias("view_uri"),
        (n % 3 != 0).alias("picked"),
    )
    return L.number(t, F.asc("key"), bucket=F.floor(F.col("key") / 10_000)).drop("key")


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return D.loaded(_incoming(spark, d), "first")


_SQL_LOADED = """(SELECT *, substr(sha256('first' || chr(31) || pos || chr(31) || path), 1, 32) AS id, CASE WHEN page_id % 3 <> 0 THEN path END AS original_path FROM
    (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS pos, 'pages/' || page_id || '.pdf' AS path, page_id || '.pdf' AS name, strlen(coalesce(html, ''))::BIGINT AS size,
    'data:' || page_id AS view_uri FROM pages WHERE page_id % 5 <> 0))"""


@query("documents_added", f"""SELECT pos + c.k * (SELECT count(*) FROM {_SQL_LOADED}) AS pos, name, 1::BIGINT AS pages, size, view_uri, original_path, c.k = 0 AND pos = 0 AS active
    FROM {_SQL_LOADED}, (VALUES (0), (1)) AS c(k)""")  # fmt: skip
def _(spark, d):
    incoming = _incoming(spark, d)
    one, active = D.add_documents(L.clear(_loaded(spark, d)), incoming, "first")
    two, active = D.add_documents(one, incoming, "second", active)
    return two.select("pos", "name", "pages", "size", "view_uri", "original_path", (F.col("id") == active).alias("active"))


@query("document_ids", f"SELECT pos, id FROM {_SQL_LOADED}")
def _(spark, d):
    return _loaded(spark, d).select("pos", "id")


@query("page_counts_written", f"SELECT pos, name, CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 0 THEN page_id + 2 ELSE 1 END AS pages FROM {_SQL_LOADED}")
def _(spark, d):
    n = F.col("page_id")
    opened = _table(spark, d, "pages").where(n % 2 == 0).select(F.concat(F.lit("pages/"), n.cast("string"), F.lit(".pdf")).alias("path"), (n + 2).alias("page_count"))
    return D.page_counts_written(_loaded(spark, d), opened).select("pos", "name", "pages")


@query("documents_with_path", f"SELECT pos, id, original_path FROM {_SQL_LOADED} WHERE original_path IS NOT NULL")
def _(spark, d):
    return D.with_original_path(_loaded(spark, d)).select("pos", "id", "original_path")


@query("merge_rows", f"SELECT pos, id, original_path AS path, name, size, 1::BIGINT AS page_count FROM {_SQL_LOADED}")
def _(spark, d):
    return D.to_merge_rows(_loaded(spark, d))


@query("dialog_list", f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, path, name, size, 1::BIGINT AS page_count FROM {_SQL_LOADED} WHERE original_path IS NOT NULL")
def _(spark, d):
    return D.dialog_list(_loaded(spark, d))


@query("open_document", f"SELECT pos, name FROM {_SQL_LOADED} ORDER BY pos LIMIT 1")
def _(spark, d):
    current = _loaded(spark, d)
    return D.require_open(current, current.where("pos = 0").first()["id"], "merge").select("pos", "name")


@query("list_snapshot", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS id, o_custkey AS who FROM orders")
def _(spark, d):
    return D.snapshot(_list(spark, d))
