"""Substring dedup by repeated-phrase automata.

1. Texts are packed in blocks, which lie in files of the shared folder. In each window of SIZE words the GRAM-word phrase
   with the smallest hash is its anchor, so equal windows have equal anchors; a window can recur only if its anchor stands
   at two places. Anchors are compared over all blocks.
2. Windows with a recurring anchor are candidates: places whose windows have equal digests are linked in a chain, so that each place
   knows one other, its `source`. Places are first linked within a block, then within bundles of blocks, and at last over all
   bundles; each level hands on one place a digest, so no task meets more than a bundle's or a row a bundle for a common passage.
3. Consecutive windows with consecutive sources are passages. A source's block is asked for the words that stand there.
4. What comes back for a block is compiled to its shard of the Aho-Corasick automata, over whole words, and all documents
   of the block stream past it. A place is marked only where the automaton finds the words of another place: this confirms
   passages word by word, digests only select what is asked for.

Each source is asked by at most one place a level, so common passages burden no block more than rare ones; a shard is at
most as large as its block, and work and memory follow the block, whatever the table's size.

Results in edge cases: null and empty texts have no words, nothing removed and the digest of the empty string; texts of
fewer words than a window keep all; repeated rows remove each other's text; every row is returned once, whatever its doc_id.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, table

#: Words of a window, of an anchor, and the bytes of text of a block.
SIZE, GRAM, BLOCK = 35, 16, 2 << 20
#: Bytes of input for each hash range, and the fewest ranges; blocks of a bundle, blocks of a task, and the most tasks.
RANGE_BYTES, RANGES, BUNDLE, TASK_BLOCKS, TASKS = 32 << 20, 64, 512, 4, 100_000
_SEEDS = (11, 23, 37)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over all n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


class Windows:
    """The windows of a group of texts: where one starts, its anchor's hash, and the places of anchors."""

    def __init__(self, spans: list[tuple[int, int]], h: np.ndarray, size: int, gram: int):
        self.n = max(0, len(h) - size + 1)
        self.valid = np.zeros(self.n, bool)
        for a, b in spans:
            if b - a >= size:
                self.valid[a : b - size + 1] = True
        self.grams = hashing.long_windows(h, gram, _SEEDS[0]) | np.uint64(1)
        self.anchor = _sliding(self.grams, size - gram + 1, np.minimum)[: self.n] if self.n else np.empty(0, np.uint64)

    def anchors(self, size: int, gram: int) -> np.ndarray:
        """The hashes at all places that are some window's anchor; a place counts once."""
        if not self.n:
            return np.empty(0, np.uint64)
        pad = np.zeros(size - gram, np.uint64)
        best = _sliding(np.r_[pad, np.where(self.valid, self.anchor, 0), pad], size - gram + 1, np.maximum)
        return self.grams[best == self.grams]


def _digests(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits; the last bit of the second is free."""
    return hashing.long_windows(h, size, _SEEDS[1]), (hashing.long_windows(h, size, _SEEDS[2]) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)


def _range_of(anchors: np.ndarray, ranges: int) -> np.ndarray:
    """Anchors are the smallest of many hashes, so they are mixed once more to spread them evenly."""
    h = hashing.mix(anchors & ~np.uint64(1))
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """First and last of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    if not n:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    firsts = np.flatnonzero(new).tolist()
    return list(zip(firsts, [*firsts[1:], n], strict=True))


#: How a shuffled row says whose it is: entries of the next level have a range, links a source.
FOUND = pa.schema([("range", pa.int64()), ("bundle", pa.int64()), ("block", pa.int64()), ("source", pa.int64()), ("data", pa.binary())])
FOUND_DDL = "range bigint, bundle bigint, block bigint, source bigint, data binary"


class Found:
    """Rows of FOUND in the making."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {f.name: [] for f in FOUND}

    def add(self, data: bytes, block, range_=None, bundle=None, source=None) -> None:
        for name, x in (("range", range_), ("bundle", bundle), ("block", block), ("source", source), ("data", data)):
            self.columns[name].append(x)

    def table(self) -> pa.Table:
        return pa.Table.from_pydict(self.columns, schema=FOUND)


# blocks in files


def _packing(root: str, size: int, gram: int, block_bytes: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder)
        part = TaskContext.get().partitionId()
        name, out, at, number = f"{part:08d}-{uuid.uuid4().hex}", None, 0, part << 32  # a name of this attempt: what is listed is what finished
        ids: list = []
        texts: list[bytes] = []
        total = 0

        def packed():
            nonlocal out, at
            found = [Windows(spans, h, size, gram).anchors(size, gram) for _, spans, _, _, _, h in hashing.gathered(texts)]
            a = np.sort(np.concatenate([*found, np.empty(0, np.uint64)]) & ~np.uint64(1))
            same = a[1:] == a[:-1]
            a = (a | np.r_[same, np.zeros(min(1, len(a)), bool)])[np.r_[np.ones(min(1, len(a)), bool), ~same]]  # the last bit: at two places already
            of = _range_of(a, ranges)
            order = np.argsort(of, kind="stable")
            a, of = a[order], of[order]
            parts = [{"range": int(of[i]), "data": a[i:j].tobytes()} for i, j in _runs(of)]
            data = zstandard.compress(b"".join(texts), 1)
            out = out or fs.open_output_stream(f"{folder}/{name}", compression=None)
            out.write(data)
            row = {"block": number, "ids": ids, "lengths": list(map(len, texts)), "name": name, "at": at, "bytes": len(data), "anchors": parts}
            at += len(data)
            return pa.RecordBatch.from_pylist([row], schema=PACKED)

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t or b"")
                total += len(texts[-1])
                if total >= block_bytes or len(ids) >= 100_000:
                    yield packed()
                    number, ids, texts, total = number + 1, [], [], 0
        if ids:
            yield packed()
        if out is not None:
            out.close()

    return run


PACKED = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("name", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()),
     ("anchors", pa.list_(pa.struct([("range", pa.int64()), ("data", pa.binary())])))]
)
PACKED_DDL = "block bigint, ids array<bigint>, lengths array<bigint>, name string, at bigint, bytes bigint, anchors array<struct<range: bigint, data: binary>>"


def _texts(root: str, row: dict) -> list[bytes]:
    """The texts of a block."""
    fs, folder = pafs.FileSystem.from_uri(root)
    with fs.open_input_file(f"{folder}/{row['name']}") as f:
        f.seek(row["at"])
        data = zstandard.decompress(f.read(row["bytes"]))
    ends = np.cumsum(np.array(row["lengths"], np.int64)).tolist()
    return [data[e - n : e] for e, n in zip(ends, row["lengths"], strict=True)]


# anchors: sorted hashes, whose last bit tells that another place is known


def _anchor_level(last: bool):
    """Of a group's anchors: rows for the blocks that still have to learn of another place, and one entry a hash for the next level."""

    def run(group: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, np.uint64) for x in group.column("data").to_pylist()]
        blocks = np.repeat(np.array(group.column("block").to_pylist(), np.int64), [len(x) for x in data])
        h = np.concatenate(data)
        order = np.argsort(h & ~np.uint64(1), kind="stable")
        h, blocks = h[order], blocks[order]
        key = h & ~np.uint64(1)
        same = key[1:] == key[:-1]
        again = np.r_[False, same] | np.r_[same, False]
        out = Found()
        tell = np.flatnonzero(again & (h == key))
        tell = tell[np.argsort(blocks[tell], kind="stable")]
        for i, j in _runs(blocks[tell]):
            out.add(key[tell[i:j]].tobytes(), int(blocks[tell[i]]))
        if not last:
            firsts = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), ~same])
            k, b = (h | again)[firsts], blocks[firsts]
            order = np.argsort(b, kind="stable")
            k, b, r = k[order], b[order], group.column("range")[0].as_py()
            for i, j in _runs(b):
                out.add(k[i:j].tobytes(), int(b[i]), range_=r)
        return out.table()

    return run


# windows: a digest, its place (a word of the block), and in the digest's last bit whether another place is known


def _packed_places(a: np.ndarray, b: np.ndarray, pos: np.ndarray) -> bytes:
    return a.tobytes() + b.tobytes() + pos.astype(np.uint32).tobytes()


def _places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 16
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n), np.frombuffer(data, np.uint32, n, 12 * n)


def _link(out: Found, block: np.ndarray, pos: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
    """Links from places to their sources, as runs of consecutive words: a row for each pair of blocks."""
    order = np.lexsort((pos, source, block))
    block, pos, source, at = block[order], pos[order].astype(np.int64), source[order], at[order].astype(np.int64)
    step = np.arange(len(pos))
    runs = np.array(_runs(block, source, pos - step, at - step), np.int64).reshape(-1, 2)
    first, length = runs[:, 0], runs[:, 1] - runs[:, 0]
    rows = np.stack([pos[first], at[first], length], 1).astype(np.uint32) if len(runs) else np.empty((0, 3), np.uint32)
    for i, j in _runs(block[first], source[first]):
        out.add(rows[i:j].tobytes(), int(block[first[i]]), source=int(source[first[i]]))


def _chained(out: Found, a: np.ndarray, b: np.ndarray, block: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Links the places of each digest: each with the one before, the first with the second. All are sorted by digest, block
    and place; who knows another place already is not linked. Returns where digests begin, and marks b where one has two places."""
    key = b & np.uint32(0xFFFFFFFE)
    same = (a[1:] == a[:-1]) & (key[1:] == key[:-1])
    needs = b == key
    second = np.flatnonzero(same) + 1
    ask = second[needs[second]]
    firsts = np.flatnonzero(np.r_[np.ones(min(1, len(a)), bool), ~same])
    two = firsts[np.r_[same, np.zeros(min(1, len(a)), bool)][firsts]]
    lead = two[needs[two]]
    who, whom = np.r_[ask, lead], np.r_[ask - 1, lead + 1]
    _link(out, block[who], pos[who], block[whom], pos[whom])
    b[two] |= np.uint32(1)
    return firsts


def _candidates(root: str, size: int, gram: int, ranges: int, bundles: int):
    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out = Found()
        if blocks.num_rows:
            row = blocks.to_pylist()[0]
            own = [np.frombuffer(p["data"], np.uint64) for p in row["anchors"]]
            own = [x[(x & np.uint64(1)) == 1] for x in own]
            known = np.sort(np.concatenate([*own, *(np.frombuffer(x, np.uint64) for x in anchors.column("data").to_pylist()), np.empty(0, np.uint64)]) | np.uint64(1))
            parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.uint64))]
            before = 0
            for _, spans, _, _, _, h in hashing.gathered(_texts(root, row)) if len(known) else ():
                w = Windows(spans, h, size, gram)
                if w.n:
                    at = np.minimum(np.searchsorted(known, w.anchor), len(known) - 1)
                    keep = np.flatnonzero(w.valid & (known[at] == w.anchor))
                    places, sub = _only(spans, h, keep)
                    a, b = _digests(sub, size)
                    parts.append((a[places], b[places], keep + before, w.anchor[keep]))
                before += len(h)
            a, b, pos, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, b, a))
            a, b, pos, anchor = a[order], b[order], pos[order], anchor[order]
            firsts = _chained(out, a, b, np.full(len(a), row["block"]), pos)
            a, b, pos, of = a[firsts], b[firsts], pos[firsts], _range_of(anchor[firsts], ranges)
            order = np.argsort(of, kind="stable")
            a, b, pos, of = a[order], b[order], pos[order], of[order]
            bundle = int(hashing.mix(np.array([row["block"]], np.uint64))[0] >> np.uint64(1)) % bundles
            for i, j in _runs(of):
                out.add(_packed_places(a[i:j], b[i:j], pos[i:j]), row["block"], range_=int(of[i]), bundle=bundle)
        return out.table()

    return run


def _window_level(last: bool):
    """Of a group's places: links, and one place a digest for the next level."""

    def run(group: pa.Table) -> pa.Table:
        data = [_places(x) for x in group.column("data").to_pylist()]
        block = np.repeat(np.array(group.column("block").to_pylist(), np.int64), [len(x[0]) for x in data])
        a, b, pos = (np.concatenate([x[i] for x in data]) for i in range(3))
        order = np.lexsort((pos, block, b & np.uint32(0xFFFFFFFE), a))
        a, b, block, pos = a[order], b[order], block[order], pos[order]
        out = Found()
        firsts = _chained(out, a, b, block, pos)
        if not last:
            a, b, block, pos = a[firsts], b[firsts], block[firsts], pos[firsts]
            order = np.argsort(block, kind="stable")
            a, b, block, pos = a[order], b[order], block[order], pos[order]
            r = group.column("range")[0].as_py()
            for i, j in _runs(block):
                out.add(_packed_places(a[i:j], b[i:j], pos[i:j]), int(block[i]), range_=r)
        return out.table()

    return run


def _only(spans: list[tuple[int, int]], h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that hold any of the sorted places, joined, and the places there."""
    bounds = np.searchsorted(at, np.array(spans, np.int64).reshape(-1, 2)).tolist()
    parts, places, total = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    for (i, j), (a, b) in zip(spans, bounds, strict=True):
        if b > a:
            parts.append(h[i:j])
            places.append(at[a:b] - i + total)
            total += j - i
    return np.concatenate(places), np.concatenate(parts)


# passages: what stands at a source, for the block that asked


def _passages(root: str, size: int):
    def run(blocks: pa.Table, links: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "source": [], "at": [], "words": []}
        if links.num_rows and blocks.num_rows:
            words = [w for t in _texts(root, blocks.to_pylist()[0]) for w in t.split()]
            asked: dict[int, list[np.ndarray]] = {}
            for block, data in zip(links.column("block").to_pylist(), links.column("data").to_pylist(), strict=True):
                asked.setdefault(block, []).append(np.frombuffer(data, np.uint32).reshape(-1, 3))
            for block, parts in asked.items():
                runs = np.concatenate(parts).astype(np.int64)
                runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
                pos, at, n = runs.T
                joined = (pos[1:] == pos[:-1] + n[:-1]) & (at[1:] == at[:-1] + n[:-1])
                firsts = np.flatnonzero(np.r_[True, ~joined])
                ends = np.r_[firsts[1:], len(pos)] - 1
                places = sorted(set(zip(at[firsts].tolist(), (at[ends] + n[ends] + size - 1).tolist(), strict=True)))
                out["block"].append(block)
                out["source"].append(blocks.column("block")[0].as_py())
                out["at"].append([s for s, _ in places])
                out["words"].append(zstandard.compress(b"\n".join(b" ".join(words[s:e]) for s, e in places), 1))
        return pa.Table.from_pydict(out, schema=PASSAGES)

    return run


PASSAGES = pa.schema([("block", pa.int64()), ("source", pa.int64()), ("at", pa.list_(pa.int64())), ("words", pa.binary())])
PASSAGES_DDL = "block bigint, source bigint, at array<bigint>, words binary"


class Shard:
    """An automaton over whole words of the passages that other places lent to a block."""

    def __init__(self, block: int, rows: list[dict]):
        #: Passage to the place in this block that lent it; None where a place elsewhere, or more than one, did.
        lent: dict[tuple[bytes, ...], int | None] = {}
        for row in rows:
            for at, text in zip(row["at"], zstandard.decompress(row["words"]).split(b"\n"), strict=True):
                p = tuple(text.split())
                lent[p] = at if row["source"] == block and lent.get(p, at) == at else None
        self.numbers = {w: i + 1 for i, w in enumerate({w for p in lent for w in p})}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, at in lent.items():
            self.automaton.add_word(tuple(map(self.numbers.__getitem__, p)), (len(p), at))
        if lent:
            self.automaton.make_automaton()

    def mark(self, words: list[bytes], first: int, marks: np.ndarray) -> None:
        """Streams a document's words past the automaton, the first of which is the block's first-th, and marks every occurrence
        of a passage that stands at another place too."""
        if not len(self.automaton):
            return
        for end, (n, at) in self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))):
            start = first + end + 1 - n
            if start != at:
                marks[start : start + n] = True
                if at is not None:
                    marks[at : at + n] = True


def _removing(root: str, texts_too: bool, schema: pa.Schema):
    def run(blocks: pa.Table, passages: pa.Table) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            texts = [t.split() for t in _texts(root, row)]
            firsts = np.cumsum([0, *map(len, texts)]).tolist()
            marks = np.zeros(firsts[-1], bool)
            shard = Shard(row["block"], passages.to_pylist())
            for words, first in zip(texts, firsts, strict=False):
                shard.mark(words, first, marks)
            for d, words, i, j in zip(row["ids"], texts, firsts, firsts[1:], strict=False):
                hit = marks[i:j]
                gone = int(hit.sum())
                kept = b" ".join(list(compress(words, (~hit).tolist())) if gone else words)
                out = {"doc_id": d, "n_words": j - i, "n_removed": gone, "kept_sha256": hashlib.sha256(kept).hexdigest()}
                if texts_too:
                    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].view(np.int8))) if gone else np.empty(0, np.int64)
                    out |= {"kept_text": kept.decode(), "spans": [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]}
                rows.append(out)
        return pa.Table.from_pylist(rows, schema=schema)

    return run


def _input_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, block_bytes: int = BLOCK, texts: bool = True, bundle: int = BUNDLE) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, n_words, n_removed, kept_sha256, and with `texts` kept_text and spans (of words)."""
    if size < 2:
        raise ValueError("a window has two words at least")
    gram = min(gram, size)
    scratch = Scratch(docs.sparkSession, "repeats")
    root = scratch.path("texts")
    docs = docs.select("doc_id", "text")
    ranges = min(1 << 31, max(RANGES, _input_bytes(docs) // RANGE_BYTES))
    packed = scratch.save(docs.mapInArrow(_packing(root, size, gram, block_bytes, ranges), PACKED_DDL), "blocks")
    n = packed.count()
    bundles, tasks = max(1, -(-n // bundle)), max(1, min(TASKS, n // TASK_BLOCKS))
    # blocks are small rows with much work behind them, so their tasks are numbered here
    dealt = packed.repartition(tasks, "block")
    blocks = dealt.drop("anchors").groupBy("block")
    anchors = packed.select("block", F.explode("anchors").alias("a")).select("a.range", F.pmod(F.xxhash64("block"), F.lit(bundles)).alias("bundle"), "block", "a.data")
    told = _levels(anchors, bundles, _anchor_level, scratch, "anchors").select("block", "data")
    found = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_candidates(root, size, gram, ranges, bundles), FOUND_DDL)
    found = scratch.save(found, "candidates", compression="none")
    places = found.where("range IS NOT NULL").select("range", "bundle", "block", "data")
    links = found.where("source IS NOT NULL").unionByName(_levels(places, bundles, _window_level, scratch, "windows")).select("block", "source", "data")
    passages = blocks.cogroup(links.groupBy("source")).applyInArrow(_passages(root, size), PASSAGES_DDL)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    if texts:
        fields += [("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        ddl += ", kept_text string, spans array<struct<start: bigint, end: bigint>>"
    return blocks.cogroup(passages.groupBy("block")).applyInArrow(_removing(root, texts, pa.schema(fields)), ddl)


def _levels(entries: DataFrame, bundles: int, level, scratch: Scratch, name: str) -> DataFrame:
    """What the levels find out for blocks: within bundles, and where there are several over all of them."""
    if bundles == 1:
        return entries.groupBy("range").applyInArrow(level(True), FOUND_DDL)
    first = scratch.save(entries.groupBy("range", "bundle").applyInArrow(level(False), FOUND_DDL), name, compression="none")
    above = first.where("range IS NOT NULL").select("range", "block", "data").groupBy("range").applyInArrow(level(True), FOUND_DDL)
    return first.where("range IS NULL").unionByName(above)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


ORACLE_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    w AS (SELECT rid, i, array_to_string(ws[i:i + {SIZE - 1}], ' ') AS k FROM d, unnest(range(1, len(ws) - {SIZE - 2})) AS u(i)),
    r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
    g AS (SELECT DISTINCT rid, unnest(range(i, i + {SIZE})) AS p FROM w JOIN r USING (k)),
    p AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
    kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM p ANTI JOIN g USING (rid, p) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (rid)"""
