"""WARC archives: written with revisit records for equal payloads, and read back by boundary-chain verification.

Writing: the SHA-1 of each payload is counted; where several pages share one, that with the largest page_id is a response
and the others are revisits that refer to it. Tasks write files to the shared folder, a gzip member (or plain bytes) a record.

Reading: files are cut in stretches of bytes. A task takes every place in its stretch where a record's magic stands for a
candidate, parses it, and gives the offset where its successor would begin, and the one where the chain from here leaves the stretch.
Pointer jumping from offset 0 of each file finds where the chain enters each stretch: a round doubles the length of the
jumps, over stretches, not records. In each stretch the candidates on the way from there are the records; magic inside a payload
is never reached. A file that yields another number of records than were written raises an error.

Results in edge cases: a null page has an empty payload; an empty payload counts as any other; pages that repeat a page_id
with one payload are all responses if it is the largest; pages without a page_id are revisits where another page has the
payload, and else responses; a null url is left out; line breaks in a url are percent-encoded. An empty table writes no
files and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, looked_up, table

#: Fixed values of the format.
PLAIN, GZIP = b"WARC/1.0\r\n", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are compared.
LEAST = 0
#: Bytes after which a file ends, of a stretch, and of one read.
FILE_BYTES, STRETCH, READ = 64 << 20, 8 << 20, 1 << 20


def name_of(page) -> str:
    return f"<urn:folioflow:page:{'none' if page is None else page}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


MANIFEST_DDL = "name string, bytes bigint, records bigint"


def _writing(root: str, compress: bool, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder)
        part, out, temporary, names, sizes, counts = TaskContext.get().partitionId(), None, "", [], [], []

        def close():
            out.close()
            fs.move(temporary, f"{folder}/{names[-1]}")  # whole files only, whichever attempt comes first

        for batch in batches:
            for page, url, html, sha, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or sizes[-1] >= file_bytes:
                    if out is not None:
                        close()
                    names.append(f"part-{part:06d}-{len(names):05d}.warc" + ".gz" * compress)
                    sizes.append(0)
                    counts.append(0)
                    temporary = f"{folder}/{names[-1]}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, compression=None)
                data = record(page, url, (html or "").encode(), base32(bytes.fromhex(sha)), refers, refers is not None)
                if compress:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                sizes[-1] += len(data)
                counts[-1] += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["name", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, scratch: Scratch, least: int = LEAST, compress: bool = True, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """pages: page_id, url, html. The folder of the archives, and name, bytes, records of each."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    same = d.where(F.col("size") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    same = scratch.save(same.where("n > 1 AND first IS NOT NULL").select("sha", "first"), "same")
    d = looked_up(d, same, ["sha"], "page_id", "url", how="left")  # a third of all pages may have one payload
    revisit = (F.col("size") >= least) & ~F.col("first").eqNullSafe(F.col("page_id"))
    d = d.select("page_id", "url", "html", "sha", F.when(revisit, F.col("first")).alias("refers"))
    root = scratch.path("archives")
    return root, scratch.save(d.mapInArrow(_writing(root, compress, file_bytes), MANIFEST_DDL), "manifest")


class _Source:
    """A file from some offset on, read as far as needed."""

    def __init__(self, f, low: int, size: int):
        self.f, self.low, self.size, self.data = f, low, size, b""

    def until(self, end: int) -> bytes:
        end = min(end, self.size)
        if end > self.low + len(self.data):
            have = self.low + len(self.data)
            self.f.seek(have)
            self.data += self.f.read(max(end - have, min(READ, self.size - have)))
        return self.data

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The gzip member at an offset, unpacked, and where it ends; None if there is none."""
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                data = self.until(pos + (READ // 4))
                piece = data[pos - self.low : pos - self.low + READ // 4]
                if not piece:
                    return None
                out.append(z.decompress(piece))
                pos += len(piece)
                if out[0] and not b"".join(out[:1]).startswith(PLAIN[: len(out[0])]):
                    return None
        except zlib.error:
            return None
        return b"".join(out), pos - len(z.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """Header fields in lower case, where the block begins, and its length; None if this is no record's head."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(PLAIN) or end < 0:
        return None
    fields = dict(re.findall(r"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", data[len(PLAIN) : end + 2].decode("utf-8", "replace")))
    fields = {k.lower(): v for k, v in fields.items()}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4, int(fields["content-length"])


def _page_of(name: str) -> int | None:
    m = re.fullmatch(r"<urn:folioflow:page:(-?\d+)>", name)
    return int(m[1]) if m else None


def _facts(fields: dict[str, str], block: bytes) -> dict:
    """What a record tells; digest and size of a response from its payload, of a revisit from its head."""
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    http = block.find(b"\r\n\r\n")
    size = None
    if kind == "response" and http >= 0:
        payload = memoryview(block)[http + 4 :]
        size, digest = len(payload), base32(hashlib.sha1(payload).digest())
    elif m := re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: http if http >= 0 else 0]):
        size = int(m[1])
    return {
        "page_id": _page_of(fields.get("warc-record-id", "")), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page_of(fields.get("warc-refers-to", "")), "url": fields.get("warc-target-uri"),
    }


RECORDS = [
    ("file", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()),
]
CANDIDATES = pa.schema([*RECORDS, ("low", pa.int64()), ("next", pa.int64()), ("exit", pa.int64())])
RECORDS_DDL = "file string, at bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
CANDIDATES_DDL = RECORDS_DDL + ", low bigint, next bigint, exit bigint"


def candidates(f, size: int, low: int, high: int, gzipped: bool) -> Iterator[dict]:
    """Every record that could begin at an offset from low up to high: at, next, and its facts."""
    magic = GZIP if gzipped else PLAIN
    source = _Source(f, low, size)
    at = low
    while True:
        data = source.until(high + len(magic) - 1)
        at = data.find(magic, at - low, high + len(magic) - 1 - low)
        if at < 0:
            return
        at += low
        if gzipped:
            found = source.member(at)
            head = parse(found[0]) if found else None
            if head and len(found[0]) == head[1] + head[2] + 4:
                yield {"at": at, "next": found[1], **_facts(head[0], found[0][head[1] : head[1] + head[2]])}
        else:
            seen, end = at, -1
            while end < 0 and seen < size:  # a head may be longer than what is read at once
                end = source.until(seen + READ).find(b"\r\n\r\n", max(at, seen - 3) - low)
                seen += READ
            head = parse(source.data[at - low : end + 4]) if end >= 0 else None
            if head and at + head[1] + head[2] + 4 <= size:
                block = source.until(at + head[1] + head[2] + 4)[at - low + head[1] :][: head[2] + 4]
                if block.endswith(b"\r\n\r\n"):
                    yield {"at": at, "next": at + head[1] + head[2] + 4, **_facts(head[0], block[:-4])}
        at += 1


def _finding(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{row['name']}") as f:
                    rows = list(candidates(f, row["bytes"], row["low"], min(row["bytes"], row["low"] + row["step"]), row["name"].endswith(".gz")))
                exits: dict[int, int] = {}
                for c in reversed(rows):  # by offset: a successor comes later
                    exits[c["at"]] = c["exit"] = exits.get(c["next"], c["next"])
                    c |= {"file": row["name"], "low": row["low"]}
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 2000], schema=CANDIDATES)

    return run


def entered(found: DataFrame, scratch: Scratch) -> DataFrame:
    """found: file, at, exit. file, at of the candidates where the chain from offset 0 enters a stretch, by pointer jumping."""
    starts, n = found.where("at = 0").select("file", "at"), found.count()
    ends = found.select("file", F.col("exit").alias("at")).distinct()
    jumps = found.select("file", "at", "exit").join(ends.unionByName(starts), ["file", "at"], "left_semi")
    jumps = scratch.save(jumps.join(found.select("file", F.col("at").alias("exit")), ["file", "exit"], "left_semi").select("file", "at", "exit"), "jumps", n)
    reached, i = scratch.save(starts, "reached", n), 0
    while jumps.limit(1).count():
        ahead = reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))
        new = scratch.save(reached.unionByName(ahead).distinct(), f"reached{i}", n)
        longer = jumps.join(jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("far")), ["file", "exit"])
        jumps = scratch.save(longer.select("file", "at", F.col("far").alias("exit")), f"jumps{i}", n)
        reached, i = new, i + 1
    return reached


def _walk(found: pa.Table, entries: pa.Table) -> pa.Table:
    """The candidates of a stretch that the chain meets from where it enters."""
    at = {x: i for i, x in enumerate(found.column("at").to_pylist())}
    after, keep = found.column("next").to_pylist(), []
    for x in entries.column("at").to_pylist():
        while (i := at.get(x)) is not None:
            keep.append(i)
            x = after[i]
    return found.take(pa.array(keep, pa.int64())).select([name for name, _ in RECORDS])


def read_archives(root: str, manifest: DataFrame, scratch: Scratch, stretch: int = STRETCH) -> DataFrame:
    """One row per record on a chain: file, at, page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    lows = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(stretch).cast("long")))
    cuts = manifest.select("name", "bytes", lows.alias("low"), F.lit(stretch).alias("step"))
    tasks = max(1, min(20_000, cuts.count()))
    found = scratch.save(cuts.repartition(tasks, "name", "low").mapInArrow(_finding(root), CANDIDATES_DDL), "candidates")
    entries = entered(found, scratch).withColumn("low", F.expr(f"at - at % {stretch}"))
    records = found.groupBy("file", "low").cogroup(entries.groupBy("file", "low")).applyInArrow(_walk, RECORDS_DDL)
    records = scratch.save(records, "records")
    told = manifest.select(F.col("name").alias("file"), "records").where("records IS NOT NULL")
    counts = records.groupBy("file").agg(F.count("*").alias("n"))
    wrong = told.join(counts, "file", "left").where("coalesce(n, 0) != records").select("file").head()
    if wrong:
        raise ValueError(f"the chain of {wrong['file']} does not hold the records that were written")
    scratch.keep("archives", "manifest", "records")
    return records


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    root, manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch)
    return read_archives(root, manifest, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
    m AS (SELECT s, max(page_id) AS first, count(*) AS n FROM p GROUP BY s)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(s, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
           CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to
    FROM p JOIN m USING (s)"""
