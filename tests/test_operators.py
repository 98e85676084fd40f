"""Hand-computed tables and plain Python models, independent of SQL."""

import json
import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.functions import scalars as S
from folioflow.operators import lists as L
from folioflow.operators import merge as M
from folioflow.operators import notify as N
from folioflow.operators import recents as R


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_size_labels(spark):
    rows = [(n,) for n in (0, 1023, 1024, 1536, 2560, 1048575, 1048576, 1572864, None)]
    assert values(spark, S.size_label(F.col("n")), rows, "n long") == ["0 B", "1023 B", "1 KB", "2 KB", "3 KB", "1024 KB", "1.0 MB", "1.5 MB", None]
    assert values(spark, S.size_label(F.col("n"), 1), rows, "n long")[2:6] == ["1.0 KB", "1.5 KB", "2.5 KB", "1024.0 KB"]


def test_relative_time(spark):
    now = datetime(2024, 3, 1, 12)
    ages = [-5, 0, 59.999, 60, 3599, 3600, 86399, 86400]
    rows = [(now - timedelta(seconds=a),) for a in ages]
    got = values(spark, S.relative_time(F.col("t"), F.lit(now).cast("timestamp_ntz")), rows, "t timestamp_ntz")
    assert got == ["Just now", "Just now", "Just now", "1m ago", "59m ago", "1h ago", "23h ago", "2024-02-29"]


def test_viewer_functions(spark):
    r = F.col("n")
    assert values(spark, S.rotate(r, 90), [(x,) for x in (-360, -90, 0, 270, 360)], "n int") == [-270, 0, 90, 0, 90]
    assert values(spark, S.rotate(r, -90), [(x,) for x in (0, -270)], "n int") == [-90, 0]
    assert values(spark, S.zoom_in(r), [(50,), (190,), (200,)], "n int") == [75, 200, 200]
    assert values(spark, S.zoom_out(r), [(60,), (200,)], "n int") == [50, 175]
    assert values(spark, S.next_page(r, F.lit(0)), [(1,)], "n int") == [0]
    assert values(spark, S.width_clamp(r), [(100,), (700,), (2000,)], "n int") == [400, 636, 900]
    jumps = [("0",), ("5",), ("6",), ("",), ("2abc",), ("abc",), (None,), (" 3",), ("99999999999999999999",)]
    assert values(spark, S.page_jump(F.col("s"), F.lit(5).cast("long"), F.lit(1).cast("long")), jumps, "s string") == [1, 5, 1, 1, 2, 1, 1, 3, 1]
    assert values(spark, S.badge(r), [(0,), (9,), (10,)], "n int") == [None, "9", "9+"]


def test_paths(spark):
    rows = [("/a/b.pdf",), ("c.PDF",), ("/a/b/",), ("C:\\x\\y.pdf",), ("/",), ("",)]
    assert values(spark, S.base_name(F.col("s")), rows, "s string") == ["b.pdf", "c.PDF", "b", "y.pdf", "", ""]
    assert values(spark, S.dir_name(F.col("s")), rows, "s string") == ["/a", ".", "/a", "C:\\x", "/", "."]
    assert values(spark, S.is_pdf(F.col("s")), rows, "s string") == [True, True, False, True, False, False]
    assert values(spark, S.output_name(F.col("s")), [("",), (None,), ("x",)], "s string") == ["document.pdf", "document.pdf", "x"]


def test_defaults(spark):
    rows = [(0.0, ""), (float("nan"), None), (None, "Arial"), (9.5, "x")]
    d = spark.createDataFrame(rows, "n double, s string").select(S.or_default(F.col("n"), 12.0), S.or_default(F.col("s"), "Helvetica"))
    assert [tuple(r) for r in d.collect()] == [(12.0, "Helvetica"), (12.0, "Helvetica"), (12.0, "Arial"), (9.5, "x")]


def test_data_url_has_no_breaks(spark):
    assert "\n" not in values(spark, S.data_url(F.col("b")), [(bytes(300),)], "b binary")[0]


def test_move_and_swap_follow_a_list_model(spark):
    n = 6
    base = spark.range(n).withColumnRenamed("id", "pos").withColumn("v", F.col("pos"))
    moves = [(i, j) for i in range(n) for j in range(n)]
    cols = [L.move_position(F.col("pos"), i, j).alias(f"m{i}{j}") for i, j in moves]
    cols += [L.swap_position(F.col("pos"), F.lit(n), i, s).alias(f"s{i}{s + 1}") for i in range(n) for s in (-1, 1)]
    rows = base.select("v", *cols).collect()
    for i, j in moves:
        model = list(range(n))
        model.insert(j, model.pop(i))
        assert [r["v"] for r in sorted(rows, key=lambda r: r[f"m{i}{j}"])] == model
    for i in range(n):
        for s in (-1, 1):
            model = list(range(n))
            if 0 <= i + s < n:
                model[i], model[i + s] = model[i + s], model[i]
            assert [r["v"] for r in sorted(rows, key=lambda r: r[f"s{i}{s + 1}"])] == model


def test_positions_stay_dense(spark):
    t = spark.range(25_000).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("k"))
    d = L.remove(t, "k", 3)
    assert d.select("pos").distinct().count() == d.count() == 25_000 - 3571
    assert d.agg(F.max("pos")).first()[0] == d.count() - 1
    batch = spark.createDataFrame([(0, 100), (1, 100), (2, 1)], "pos long, k long")
    assert [r["k"] for r in L.new_only(batch, t, "k").orderBy("pos").collect()] == [100, 100]
    assert L.page_numbers(spark.createDataFrame([(0,), (2,)], "n long"), "n").count() == 2


def requests(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, path string, page_range string")


@pytest.fixture(scope="module")
def info(spark):
    return spark.createDataFrame([("a", "a", 10, 3, "1.0"), ("b", "b", 20, 10, "1.0"), ("e", "e", 0, 0, "1.0")], "path string, name string, size long, page_count long, version string")


def pages(df):
    rows = sorted(map(tuple, df.collect()))
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return [r[1:] for r in rows]


def test_merge(spark, info):
    whole = [("a", i) for i in (1, 2, 3)]
    assert pages(M.merge(requests(spark, ("a", "all"), ("e", ""), ("a", None)), info)) == whole + whole
    assert pages(M.merge(requests(spark, ("a", "all")), info)) == whole
    assert pages(M.merge(requests(spark, ("b", "3,7,9-10,3"), ("a", "all")), info)) == [("b", p) for p in (3, 7, 9, 10, 3)] + whole
    assert pages(M.delete_pages(requests(spark, ("a", "2"), ("b", "1-9"), ("a", "")), info)) == [("a", 1), ("a", 3), ("b", 10)] + whole


@pytest.mark.parametrize("text", ["0", "4", "2-1", "x", "1,,2", "1-9", "-1"])
def test_bad_ranges_stop_the_query(spark, info, text):
    with pytest.raises(Exception, match="bad page range"):
        M.select_pages(requests(spark, ("a", text)), info).collect()


def test_guards(spark, info):
    with pytest.raises(ValueError):
        M.merge(requests(spark), info)
    with pytest.raises(ValueError):
        M.merge(requests(spark, ("a", "")), info, min_files=2)
    with pytest.raises(ValueError):
        M.checked(requests(spark, ("a", "")), output="")
    with pytest.raises(Exception, match="no such document"):
        M.manifest(requests(spark, ("a", ""), ("zz", "")), info).collect()
    errors = M.enriched(requests(spark, ("zz", ""), ("a", "")), info, fail_fast=False)
    assert [(r["pos"], r["path"]) for r in M.readable(errors).collect()] == [(0, "a")]


def test_recents_follow_a_model(spark, tmp_path):
    rng, model, current = random.Random(5), {}, None
    start = datetime(2024, 1, 1)
    for step in range(12):
        batch = [(f"p{rng.randrange(30)}.pdf", f"n{step}", start + timedelta(minutes=100 * step + k), k, step) for k in range(8)]
        batch = sorted({b[0]: b for b in batch}.values(), key=lambda b: b[2])
        for b in batch:
            model.pop(b[0], None)
            model[b[0]] = b
        model = dict(list(model.items())[-20:])
        new = spark.createDataFrame(batch, "path string, name string, last_opened timestamp, size long, page_count long")
        current = R.recents(new) if current is None else R.add(current, new)
        current = spark.createDataFrame(current.collect(), current.schema)
    assert [r["path"] for r in current.orderBy("pos").collect()] == list(model)[::-1]
    file = tmp_path / "recents.json"
    file.write_text(R.export_json(current))
    assert json.loads(file.read_text())[0].keys() == {"path", "name", "lastOpened", "size", "pageCount"}
    back = R.load_json(spark, f"file://{file}")
    assert sorted(map(tuple, back.select(*current.columns).collect())) == sorted(map(tuple, current.collect()))
    assert R.load_json(spark, f"file://{tmp_path}/none.json").count() == 0


def test_notification_fold(spark):
    c = [(1, "add", "a"), (2, "add", "b"), (3, "mark", "a"), (4, "clear", "b"), (5, "add", "c"), (6, "mark_all", None), (7, "add", "a")]
    d = spark.createDataFrame(c, "seq long, command string, id string")
    assert sorted(map(tuple, N.folded(d).collect())) == [("a", 7, False), ("c", 5, True)]
    d = d.unionByName(spark.createDataFrame([(8, "clear_all", None), (9, "add", "z")], d.schema))
    assert sorted(map(tuple, N.folded(d).collect())) == [("z", 9, False)]


def pdf(n, compressed=False):
    kids = b"".join(b"%d 0 obj << /Type /Page /Parent 2 0 R >> endobj\n" % (i + 3) for i in range(n))
    if compressed:
        data = zlib.compress(b" ".join(b"<< /Type /Page /Parent 2 0 R >>" for _ in range(n)))
        kids = b"9 0 obj << /Type /ObjStm /N %d /Length %d >>\nstream\n" % (n, len(data)) + data + b"\nendstream endobj\n"
    return b"%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Count " + b"%d >> endobj\n" % n + kids + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_files(spark, tmp_path):
    from folioflow.sources import files

    (tmp_path / "a.pdf").write_bytes(pdf(3))
    (tmp_path / "B.PDF").write_bytes(pdf(5, True))
    (tmp_path / "bad.pdf").write_bytes(b"hello")
    (tmp_path / "c.txt").write_bytes(b"x")
    rows = {r["name"]: (r["page_count"], r["error"] is None) for r in files.documents(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.pdf": (3, True), "B.PDF": (5, True), "bad.pdf": (None, False)}
    assert files.listing(spark, f"file://{tmp_path}").count() == 4
    assert not files.all_valid(files.documents(spark, f"file://{tmp_path}"))
    here, gone = f"file://{tmp_path}/a.pdf", f"file://{tmp_path}/none.pdf"
    assert files.missing_paths(spark, [gone, here]) == [gone]
    files.copy_file(spark, here, f"file://{tmp_path}/out/x.pdf")
    assert (tmp_path / "out/x.pdf").read_bytes() == pdf(3)


def test_streams(spark, tmp_path):
    from folioflow.streaming import notifications as T

    openings = [(f"p{i % 25}.pdf", "n", datetime(2024, 1, 1) + timedelta(minutes=i), 1, 1) for i in range(90)]
    schema = "path string, name string, last_opened timestamp, size long, page_count long"
    for k in range(3):
        spark.createDataFrame(openings[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = f"file://{tmp_path}/recents"
    T.keep_recents(stream, store).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    batch = R.recents(spark.createDataFrame(openings, schema))
    assert sorted(map(tuple, T.latest(spark, store).collect())) == sorted(map(tuple, batch.collect()))


def test_expiry_over_repeats(spark, tmp_path):
    """A repeated success expires once, counted from its last coming; one that became an error stays."""
    import time

    from folioflow.streaming import notifications as T

    seen, schema = [], "id string, type string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "success"), ("b", "success"), ("c", "error"), ("d", "success")])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    writer = T.expiring(stream, seconds=6).writeStream.outputMode("update").foreachBatch(lambda d, _: seen.extend((r["id"], r["state"], time.time()) for r in d.collect()))
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def wait(f):
        end = time.time() + 60
        while not f() and time.time() < end and query.isActive:
            time.sleep(0.2)

    try:
        wait(lambda: len(seen) >= 4)
        put([("a", "success"), ("b", "error")])
        wait(lambda: sum(s == "shown" for _, s, _ in seen) >= 6)
        again = max(t for i, s, t in seen if (i, s) == ("a", "shown"))
        wait(lambda: {i for i, s, _ in seen if s == "expired"} >= {"a", "d"})
        time.sleep(3)
        assert query.isActive and query.exception() is None
    finally:
        query.stop()
    expired = [(i, t) for i, s, t in seen if s == "expired"]
    assert sorted(i for i, _ in expired) == ["a", "d"] and dict(expired)["a"] > again + 3


def test_documents(spark, tmp_path):
    from folioflow.operators import documents as D
    from folioflow.sources import files, store

    rows = [(0, "/x/a.pdf", "a.pdf", 3, "data:a", True), (1, "/x/bad.pdf", "bad.pdf", 1, None, True), (2, "c.pdf", "c.pdf", 5, "blob:c", False)]
    batch = spark.createDataFrame(rows, "pos long, path string, name string, size long, view_uri string, picked boolean")
    one, active = D.add_documents(D.loaded(batch.limit(0), "0"), batch, "1")
    got = [(r["pos"], r["name"], r["pages"], r["original_path"]) for r in one.orderBy("pos").collect()]
    assert got == [(0, "a.pdf", 1, "/x/a.pdf"), (1, "c.pdf", 1, None)] and D.require_open(one, active, "x").first()["name"] == "a.pdf"
    two, same = D.add_documents(one, batch, "2", active)
    assert same == active and two.select("id").distinct().count() == 4 and D.dialog_list(two).count() == 2
    assert D.add_documents(one.limit(0), batch.limit(0), "3")[1] is None
    for wrong in (None, "none"):
        with pytest.raises(ValueError, match="open a document"):
            D.require_open(one, wrong, "merge")
    info = spark.createDataFrame([("/x/a.pdf", 9)], "path string, page_count long")
    assert [r["pages"] for r in D.page_counts_written(one, info).orderBy("pos").collect()] == [9, 1]
    root = store.location(spark, f"file://{tmp_path}/deep/store")
    assert (tmp_path / "deep/store").is_dir() and store.recents_file(spark, root) == f"{root}/recent.json"
    files.write_files(spark.createDataFrame([("a.pdf", files.blank_pdf(4)), ("b.pdf", b"x")], "name string, content binary"), root)
    with pytest.raises(Exception, match="not a readable PDF"):
        files.pdf_info(spark, root).collect()
    info = files.pdf_info(spark, f"{root}/a.pdf")
    assert [(r["name"], r["page_count"]) for r in info.collect()] == [("a.pdf", 4)]
    path = info.first()["path"]
    assert pages(M.merge_paths(spark, [path, path], info)) == [(path, p) for p in (1, 2, 3, 4)] * 2
    with pytest.raises(ValueError):
        M.merge_paths(spark, [path, ""], info)
    R.save_json(R.recents(files.file_info(spark, root)), store.recents_file(spark, root))
    assert json.loads((tmp_path / "deep/store/recent.json").read_text())[0]["pageCount"] == 0
