"""Queries over whole tables, one or more for each operator, and the same in DuckDB SQL.

No table holds document files, so conversations stand for documents (a turn is a page), document lengths for file sizes, page
URLs for paths, and events for openings and notifications.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lists as L
from ..operators import merge as M
from ..operators import notify as N
from ..operators import recents as R
from ..operators.spans import relative_spans
from ..schemas import RECENTS_KEPT, TOASTS_SHOWN, TTL_SECONDS

#: The moment that queries take for the present.
NOW = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PATH = "'conversations/' || conv_id || '.pdf'"
SQL_INFO = f"""(SELECT {_PATH} AS path, conv_id || '.pdf' AS name, sum(strlen(coalesce(text, '')))::BIGINT AS size, count(*)::BIGINT AS page_count,
    '1.0' AS version, min(conv_id) AS conv_id FROM conversations GROUP BY conv_id)"""
SQL_REQUESTS = f"""(SELECT row_number() OVER (ORDER BY conv_id DESC) - 1 AS pos, path, page_count, size, conv_id,
    CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'all' WHEN 2 THEN '1' ELSE page_count || '-' || page_count || ',1' END AS page_range FROM {SQL_INFO})"""
SQL_KIND = "CASE event_type WHEN 'signup' THEN 'success' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END"


def query(name: str, sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _info(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".pdf"))
    return M.doc_info(_table(spark, d, "conversations").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text")), "path", "text")


def _conv(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(-?\d+)\.pdf$", 1).cast("long")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    n, c = F.col("page_count").cast("string"), _conv()
    r = F.when(c % 4 == 0, F.lit("")).when(c % 4 == 1, F.lit("all")).when(c % 4 == 2, F.lit("1")).otherwise(F.concat(n, F.lit("-"), n, F.lit(",1")))
    numbered = L.number(_info(spark, d), F.desc(_conv()), bucket=-F.floor(_conv() / 10_000))
    return numbered.select("pos", "path", r.alias("page_range"))


@query("doc_info", f"SELECT path, name, size, page_count, version FROM {SQL_INFO}")
def _(spark, d):
    return _info(spark, d)


@query("merge_manifest", f"""SELECT row_number() OVER (ORDER BY pos, t.turn) AS out_page, path, t.turn + 1 AS src_page
    FROM {SQL_REQUESTS} r JOIN conversations t USING (conv_id)""")  # fmt: skip
def _(spark, d):
    return M.manifest(_requests(spark, d), _info(spark, d))


@query("merge_with_duplicates", f"""SELECT row_number() OVER (ORDER BY copy, pos, t.turn) AS out_page, path, t.turn + 1 AS src_page
    FROM {SQL_REQUESTS} r JOIN conversations t USING (conv_id), (VALUES (0), (1)) AS c(copy)""")  # fmt: skip
def _(spark, d):
    r = _requests(spark, d)
    return M.manifest(L.append(r, r), _info(spark, d))


@query("merge_totals", f"SELECT count(*) AS n_files, coalesce(sum(page_count), 0)::BIGINT AS total_pages, coalesce(sum(size), 0)::BIGINT AS total_size FROM {SQL_REQUESTS}")
def _(spark, d):
    return M.totals(_requests(spark, d), _info(spark, d))


@query("merge_totals_empty", "SELECT 0::BIGINT AS n_files, 0::BIGINT AS total_pages, 0::BIGINT AS total_size")
def _(spark, d):
    return M.totals(L.clear(_requests(spark, d)), _info(spark, d))


@query("has_ranges", f"SELECT bool_or(page_range NOT IN ('', 'all')) AS has_ranges FROM {SQL_REQUESTS}")
def _(spark, d):
    return M.has_ranges(_requests(spark, d))


@query("range_map", f"SELECT path, CASE WHEN page_range = 'all' THEN '' ELSE page_range END AS page_range FROM {SQL_REQUESTS}")
def _(spark, d):
    return M.range_map(_requests(spark, d))


_TOKENS = f"""(SELECT pos, path, tok, CASE WHEN part IN ('', 'all') THEN 1 ELSE split_part(part, '-', 1)::BIGINT END AS low,
    CASE WHEN part IN ('', 'all') THEN page_count WHEN contains(part, '-') THEN split_part(part, '-', 2)::BIGINT ELSE part::BIGINT END AS high
    FROM (SELECT *, unnest(string_split(page_range, ',')) AS part, generate_subscripts(string_split(page_range, ','), 1) AS tok FROM {SQL_REQUESTS}))"""


@query("select_pages", f"""SELECT row_number() OVER (ORDER BY pos, tok, src_page) AS out_page, path, src_page
    FROM (SELECT pos, path, tok, unnest(range(low, high + 1)) AS src_page FROM {_TOKENS})""")  # fmt: skip
def _(spark, d):
    return M.merge(_requests(spark, d), _info(spark, d))


@query("delete_pages", f"""SELECT row_number() OVER (ORDER BY pos, p) AS out_page, path, p AS src_page
    FROM (SELECT pos, path, unnest(range(1, page_count + 1)) AS p FROM {SQL_REQUESTS})
    WHERE (pos, p) NOT IN (SELECT k.pos, unnest(range(low, high + 1)) FROM {_TOKENS} k JOIN {SQL_REQUESTS} r ON k.pos = r.pos WHERE r.page_range NOT IN ('', 'all'))""")  # fmt: skip
def _(spark, d):
    return M.delete_pages(_requests(spark, d), _info(spark, d))


@query("move_page", "SELECT conv_id, CASE WHEN n > 3 THEN CASE WHEN turn = 1 THEN 3 WHEN turn > 1 AND turn <= 3 THEN turn - 1 ELSE turn END ELSE turn END AS pos, role "
       "FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")  # fmt: skip
def _(spark, d):
    t = _table(spark, d, "conversations")
    n = t.groupBy("conv_id").count()
    moved = F.when(F.col("count") > 3, L.move_position(F.col("turn"), 1, 3)).otherwise(F.col("turn"))
    return t.join(n, "conv_id").select("conv_id", moved.alias("pos"), "role")


@query("enriched_errors", f"""SELECT row_number() OVER (ORDER BY copy, pos) - 1 AS pos, CASE WHEN copy = 0 THEN path ELSE 'none/' || path END AS path, copy = 1 AS failed
    FROM {SQL_REQUESTS}, (VALUES (0), (1)) AS c(copy)""")  # fmt: skip
def _(spark, d):
    r = _requests(spark, d)
    both = L.append(r, r.withColumn("path", F.concat(F.lit("none/"), "path")))
    return M.enriched(both, _info(spark, d), fail_fast=False, only_pdf=True).select("pos", "path", F.col("error").isNotNull().alias("failed"))


@query("readable_requests", f"SELECT pos, path FROM {SQL_REQUESTS}")
def _(spark, d):
    r = _requests(spark, d)
    both = L.append(r.withColumn("path", F.concat(F.lit("none/"), "path")), r)
    return M.readable(M.enriched(both, _info(spark, d), fail_fast=False)).select("pos", "path")


@query("missing_documents", f"SELECT 'none/' || path AS path FROM {SQL_REQUESTS}")
def _(spark, d):
    r = _requests(spark, d)
    return M.missing(r.unionByName(r.withColumn("path", F.concat(F.lit("none/"), "path"))), _info(spark, d))


# ordered lists: all orders by key, as a list

_LIST = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS id, o_custkey AS who FROM orders)"


def _list(spark, d) -> DataFrame:
    t = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"))
    return L.number(t, F.asc("id"), bucket=F.floor(F.col("id") / 10_000))


@query("list_append", f"SELECT pos + c.k * (SELECT count(*) FROM orders) AS pos, id, who + c.k AS who FROM {_LIST}, (VALUES (0), (1)) AS c(k)")
def _(spark, d):
    t = _list(spark, d)
    return L.append(t, t.withColumn("who", F.col("who") + 1))


@query("list_prepend", f"SELECT pos + c.k * (SELECT count(*) FROM orders) AS pos, id, who + 1 - c.k AS who FROM {_LIST}, (VALUES (0), (1)) AS c(k)")
def _(spark, d):
    t = _list(spark, d)
    return L.prepend(t, t.withColumn("who", F.col("who") + 1))


@query("list_remove", f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, who FROM {_LIST} WHERE who <> 7")
def _(spark, d):
    return L.remove(_list(spark, d), "who", 7)


@query("list_swap_down", f"SELECT CASE pos WHEN 4 THEN 5 WHEN 5 THEN 4 ELSE pos END AS pos, id, who FROM {_LIST}")
def _(spark, d):
    return L.swap(_list(spark, d), 4, 1)


@query("list_swap_up_at_top", f"SELECT pos, id, who FROM {_LIST}")
def _(spark, d):
    return L.swap(_list(spark, d), 0, -1)


@query("list_move", f"SELECT CASE WHEN pos = 3 THEN 100 WHEN pos > 3 AND pos <= 100 THEN pos - 1 ELSE pos END AS pos, id, who FROM {_LIST}")
def _(spark, d):
    return L.move(_list(spark, d), 3, 100)


@query("list_move_back", f"SELECT CASE WHEN pos = 100 THEN 3 WHEN pos >= 3 AND pos < 100 THEN pos + 1 ELSE pos END AS pos, id, who FROM {_LIST}")
def _(spark, d):
    return L.move(_list(spark, d), 100, 3)


@query("add_without_existing", f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, who FROM {_LIST} WHERE who NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    known = _table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("who"))
    return L.new_only(_list(spark, d), known, "who")


@query("list_find", f"SELECT pos, id, who FROM {_LIST} WHERE who = 7 ORDER BY pos LIMIT 1")
def _(spark, d):
    return L.find(_list(spark, d), "who", 7)


@query("list_update", f"SELECT pos, id, CASE WHEN who = 7 THEN -1 ELSE who END AS who FROM {_LIST}")
def _(spark, d):
    return L.update(_list(spark, d), "who", 7, who=F.lit(-1).cast("long"))


@query("next_active", f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, who FROM {_LIST} WHERE pos > 0 ORDER BY pos LIMIT 1")
def _(spark, d):
    return L.first(L.renumber(_list(spark, d).where("pos > 0")))


@query("list_clear", f"SELECT pos, id, who FROM {_LIST} WHERE false")
def _(spark, d):
    return L.clear(_list(spark, d))


@query("list_ordinal", f"SELECT pos + 1 AS place, id FROM {_LIST}")
def _(spark, d):
    return _list(spark, d).select(L.ordinal(F.col("pos")).alias("place"), "id")


@query("page_numbers", f"SELECT path, unnest(range(1, page_count + 1)) AS page_number FROM {SQL_INFO}")
def _(spark, d):
    return L.page_numbers(_info(spark, d), "page_count").select("path", "page_number")


# recents and notifications


def _opened(spark, d) -> DataFrame:
    t = _table(spark, d, "events")
    return t.select(F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("ts").alias("last_opened"), "event_id")


_RECENT = "SELECT 'users/' || user_id || '.pdf' AS path, max(ts) AS last_opened, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE {} GROUP BY user_id"


@query("recents_top20", f"SELECT row_number() OVER (ORDER BY last_opened DESC, event_id DESC, path) - 1 AS pos, * FROM ({_RECENT.format('true')}) ORDER BY pos LIMIT {RECENTS_KEPT}")
def _(spark, d):
    return R.recents(_opened(spark, d), RECENTS_KEPT, "event_id")


@query("recents_remove", f"SELECT row_number() OVER (ORDER BY last_opened DESC, event_id DESC, path) - 1 AS pos, * FROM ({_RECENT.format('user_id <> 7')}) ORDER BY pos LIMIT {RECENTS_KEPT}")
def _(spark, d):
    return R.recents(_opened(spark, d).where(F.col("path") != "users/7.pdf"), RECENTS_KEPT, "event_id")


def _log(spark, d) -> DataFrame:
    t, e = _table(spark, d, "events"), F.col("event_type")
    kind = F.when(e == "signup", F.lit("success")).when(e == "error", F.lit("error")).when(e == "purchase", F.lit("warning")).otherwise(F.lit("info"))
    read = F.when(F.col("value") > 50, F.lit(True))
    return t.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), kind.alias("type"), "ts", read.alias("read"))


_LOG = f"(SELECT lpad(event_id::VARCHAR, 12, '0') AS id, {SQL_KIND} AS type, ts, CASE WHEN value > 50 THEN true END AS read FROM events)"


@query("visible_ttl", f"SELECT * FROM {_LOG} WHERE NOT (type = 'success' AND ts <= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL {TTL_SECONDS} SECOND)")
def _(spark, d):
    return N.visible(_log(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query("unread_count", f"SELECT count(*) FILTER (NOT coalesce(read, false)) AS unread FROM {_LOG}")
def _(spark, d):
    return N.unread(_log(spark, d))


@query("toasts_top5", f"SELECT * FROM {_LOG} ORDER BY ts DESC, id LIMIT {TOASTS_SHOWN}")
def _(spark, d):
    return N.toasts(_log(spark, d))


@query("mark_all_read", f"SELECT id, type, ts, true AS read FROM {_LOG}")
def _(spark, d):
    return N.mark_all_read(_log(spark, d))


@query("notification_style", f"SELECT id, type AS style FROM {_LOG}")
def _(spark, d):
    return _log(spark, d).select("id", S.notification_style(F.col("type")).alias("style"))


_COMMAND = "CASE event_type WHEN 'click' THEN 'mark' WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'mark_all' ELSE 'add' END"


@query("notification_state", f"""WITH c AS (SELECT event_id AS seq, {_COMMAND} AS command, 'user-' || user_id AS id FROM events),
    a AS (SELECT max(seq) FILTER (command = 'mark_all') AS m FROM c),
    g AS (SELECT id, max(seq) FILTER (command = 'add') AS seq, max(seq) FILTER (command = 'mark') AS m, max(seq) FILTER (command = 'clear') AS c FROM c GROUP BY id)
    SELECT g.id, g.seq, coalesce(g.m, -1) > g.seq OR coalesce(a.m, -1) > g.seq AS read FROM g, a WHERE g.seq IS NOT NULL AND coalesce(g.c, -1) < g.seq""")  # fmt: skip
def _(spark, d):
    e = F.col("event_type")
    command = F.when(e == "click", F.lit("mark")).when(e == "error", F.lit("clear")).when(e == "signup", F.lit("mark_all")).otherwise(F.lit("add"))
    t = _table(spark, d, "events")
    return N.folded(t.select(F.col("event_id").alias("seq"), command.alias("command"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("id")))


@query("relative_time", f"""SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago'
    ELSE strftime(ts, '%Y-%m-%d') END AS label FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 AS s FROM events)""")  # fmt: skip
def _(spark, d):
    return _table(spark, d, "events").select("event_id", S.relative_time(F.col("ts"), F.lit(NOW).cast("timestamp_ntz")).alias("label"))


# scalars

_MB = "((n * 10 + 524288) // 1048576 // 10) || '.' || ((n * 10 + 524288) // 1048576 % 10) || ' MB'"
_KB1 = "((n * 10 + 512) // 1024 // 10) || '.' || ((n * 10 + 512) // 1024 % 10) || ' KB'"
_SIZES = "(SELECT doc_id, n_chars * 97 AS n FROM documents)"


def _size_sql(kb: str) -> str:
    return f"SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {kb} ELSE {_MB} END AS label FROM {_SIZES}"


@query("size_label", _size_sql("((n + 512) // 1024) || ' KB'"))
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.size_label(F.col("n_chars") * 97).alias("label"))


@query("size_label_header", _size_sql(_KB1))
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.size_label(F.col("n_chars") * 97, 1).alias("label"))


@query("badge_and_plural", f"SELECT path, CASE WHEN page_count > 9 THEN '9+' WHEN page_count > 0 THEN page_count::VARCHAR END AS badge, "
       f"page_count || ' ' || CASE WHEN page_count = 1 THEN 'page' ELSE 'pages' END AS pages, page_count || ' PDFs merged successfully' AS message FROM {SQL_INFO}")  # fmt: skip
def _(spark, d):
    n = F.col("page_count")
    return _info(spark, d).select("path", S.badge(n).alias("badge"), S.pluralise(n, "page", "pages").alias("pages"), S.merged_message(n).alias("message"))


@query("path_parts", r"""SELECT page_id, regexp_extract(url, '([^/\\]+)[/\\]*$', 1) AS base,
    CASE WHEN regexp_extract(url, '^(.*?)[/\\]+[^/\\]*[/\\]*$', 1) <> '' THEN regexp_extract(url, '^(.*?)[/\\]+[^/\\]*[/\\]*$', 1) WHEN starts_with(url, '/') THEN '/' ELSE '.' END AS dir,
    ends_with(lower(url), '.pdf') AS is_pdf, starts_with(url, 'blob:') AS is_blob, CASE WHEN url = '' THEN 'document.pdf' ELSE url END AS output FROM pages""")  # fmt: skip
def _(spark, d):
    u = F.col("url")
    return _table(spark, d, "pages").select(
        "page_id", S.base_name(u).alias("base"), S.dir_name(u).alias("dir"), S.is_pdf(u).alias("is_pdf"), S.is_blob_url(u).alias("is_blob"), S.output_name(u).alias("output")
    )


@query("data_url", "SELECT item_id, 'data:application/pdf;base64,' || base64(encode(text)) AS url FROM benchmark")
def _(spark, d):
    return _table(spark, d, "benchmark").select("item_id", S.data_url(F.encode("text", "UTF-8")).alias("url"))


@query("viewer_state", """SELECT l_orderkey, l_linenumber, l_partkey, least(z + 25, 200) AS zoom_in, greatest(z - 25, 50) AS zoom_out, z / 100.0::DOUBLE AS scale,
    ((l_linenumber - 4) * 90 + 90) % 360 AS turned, ((l_linenumber - 4) * 90 - 90) % 360 AS turned_back, greatest(1, l_linenumber - 1) AS before,
    least(5, l_linenumber + 1) AS after, greatest(400, least(z * 6 - 64, 900)) AS width FROM (SELECT *, 50 + (l_partkey % 7)::INT * 25 AS z FROM lineitem)""")  # fmt: skip
def _(spark, d):
    z, n = (F.lit(50) + (F.col("l_partkey") % 7).cast("int") * 25), F.col("l_linenumber")
    return _table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.zoom_in(z).alias("zoom_in"), S.zoom_out(z).alias("zoom_out"), S.scale(z).alias("scale"),
        S.rotate((n - 4) * 90, 90).alias("turned"), S.rotate((n - 4) * 90, -90).alias("turned_back"), S.previous_page(n).alias("before"),
        S.next_page(n, F.lit(5)).alias("after"), S.width_clamp(z * 6).alias("width"),
    )


@query("page_jump", r"""SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 25 THEN n ELSE 1 END AS page
    FROM (SELECT p_partkey, TRY_CAST(regexp_extract(p_size || p_type, '^\s*([+-]?\d+)', 1) AS BIGINT) AS n FROM part)""")  # fmt: skip
def _(spark, d):
    t = F.concat(F.col("p_size").cast("string"), "p_type")
    return _table(spark, d, "part").select("p_partkey", S.page_jump(t, F.lit(25).cast("long"), F.lit(1).cast("long")).alias("page"))


@query("relative_spans", """SELECT l_orderkey::VARCHAR AS id, l_returnflag AS text, l_quantity - l_discount AS x, l_extendedprice - l_tax AS y, l_quantity AS width, l_tax AS height,
    CASE WHEN l_discount = 0 THEN 12 ELSE l_discount END AS font_size, CASE WHEN l_returnflag = 'N' THEN 'Helvetica' ELSE l_returnflag END AS font_family, '#000000' AS color FROM lineitem""")  # fmt: skip
def _(spark, d):
    t = _table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_returnflag"))
    spans = t.select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("left"), F.col("l_extendedprice").alias("top"),
        F.col("l_quantity").alias("width"), F.col("l_tax").alias("height"), F.col("l_discount").alias("parent_left"), F.col("l_tax").alias("parent_top"),
        F.col("l_discount").alias("font_size"), flag.alias("font_family"), F.lit(None).cast("string").alias("color"),
    )
    return relative_spans(spans)
