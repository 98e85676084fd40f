"""Token-ID output: canonical length-limited Huffman codes of token ids, in files of independent blocks.

1. Rows are dealt and sorted by doc_id; tasks encode their texts with the tokenizers library, append the end id and store
   blocks of whole documents, numbered by part and place.
2. Ids are counted over all blocks. From the counts come code lengths of at most LIMIT bits (package-merge), and from the
   lengths alone the codes.
3. Tasks write the blocks' ids as code bits to files, in order. A file holds the code lengths and its blocks; a block
   holds its documents, the bit offset of every STRIDE-th id, and the bits.
4. Files are read back block by block; a table of LIMIT bits decodes all stretches between checkpoints side by side.

File format, little-endian: magic, u32 length and zstd-compressed code lengths (a byte an id); then blocks: 4 u64 (documents,
ids, checkpoints, bytes of bits), an i64 doc_id, a u8 (1: has a doc_id) and a u64 number of ids for each document, u64 bit
offsets, bits (most significant first; each SEGMENT of ids starts at a byte).

Results in edge cases: null and empty texts have the end id alone; rows without a doc_id come first; rows that repeat a
doc_id stand together, ordered by their text, and each is returned; an empty table writes no files and returns no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, table

#: Fixed values of the contract.
END_ID = 2
VOCABULARY_FILE = "byte_bpe_50k.json"
MAGIC = b"FOLIOHUF"
#: Longest code in bits; ids between checkpoints; ids of a segment and of a block; bytes after which a file ends.
LIMIT, STRIDE, SEGMENT, BLOCK_IDS, FILE_BYTES = 18, 256, 1 << 20, 1 << 19, 32 << 20
#: Ids that are coded at a time; a multiple of STRIDE.
RUN = 1 << 14
#: Input bytes of a part, and the most parts.
PART_BYTES, PARTS = 8 << 20, 100_000
#: A space that stands behind something else than white space, and white space that is seldom met.
CUT = re.compile(r"(?<=\S) ")
RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Letters and marks that the pre-tokeniser parts, and of which there is no doubt in any version of Unicode.
LETTERS, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+"), ".,;:!?#$%&*+-/<=>@^_|~()[]{}"
#: The characters for which the byte-level alphabet has others: what does not print follows behind the 256th, in order.
SPACE = chr(256 + 32)
BYTES = {c: 256 + i for i, c in enumerate(c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or c >= 174))}
#: Bytes of cuts that a worker remembers, twice: those met lately and those before; what an entry takes beside its characters.
MEMORY, ENTRY = 72 << 20, 230
#: Characters from which on a cut is not parted at line breaks, nor a text's first cut remembered.
LONG = 256


class _Cuts(dict):
    """The ids of cuts behind a fixed start, as bytes; what is not there is put together from its parts or comes from the library."""

    def __init__(self, encoder: Encoder, start: str, old: dict[str, bytes]):
        self.encoder, self.start, self.old, self.lead = encoder, start, old, start.replace(" ", SPACE)

    def __missing__(self, cut: str) -> bytes:
        found = self.old.get(cut)
        if found is None:
            if cut.isascii() and cut.isalpha():  # most of what is new
                found = array(self.encoder.code, [t.id for t in self.encoder.tokenize(self.lead + cut)]).tobytes()
            else:
                if "\n" in cut and len(cut) < LONG:  # one line break between other characters is a piece
                    left, _, right = cut.partition("\n")
                    if left and right and not left[-1].isspace() and not right[0].isspace():
                        bare = self.encoder.bare
                        return self[left] + bare["\n"] + bare[right]
                stem = cut.rstrip(MARKS)
                if not stem or not (stem.isascii() and stem.isalpha() or LETTERS.fullmatch(stem)):
                    found = self.encoder.ids(self.start + cut)
                elif len(stem) < len(cut):  # letters are a piece, and so are the marks behind them
                    found = self[stem] + self.encoder.bare[cut[len(stem) :]]
                else:
                    found = self.encoder.word_ids(self.start + cut)
        self[cut] = found
        self.encoder.taken += len(cut) + ENTRY
        return found


class Encoder:
    """The library's ids of whole texts.

    No piece of the library's pre-tokeniser has white space behind other characters, so a text may be cut before each space
    that follows none: the ids of the cuts, one after the other, are those of the text. A worker remembers the ids of cuts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if max(self.size, END_ID + 1) <= 1 << 16 else np.uint32
        self.code, self.model = "H" if self.kind is np.uint16 else "I", self.tokenizer.model
        self.tokenize = self.model.tokenize
        self.end = np.array([END_ID], self.kind).tobytes()
        self.taken, self.bare, self.spaced = 0, _Cuts(self, "", {}), _Cuts(self, " ", {})

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def word_ids(self, text: str) -> bytes:
        """The ids of letters alone, behind a space or nothing: a piece as it stands, so that the library's model can be asked at once."""
        seen = text.replace(" ", SPACE) if text.isascii() else text.encode().decode("latin-1").translate(BYTES)
        return array(self.code, [t.id for t in self.tokenize(seen)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as bytes, with the end id."""
        out = []
        for t in texts:
            wide = "  " in t or "\n " in t or any(map(t.__contains__, RARE))
            first, *cuts = CUT.split(t) if wide else t.split(" ")
            out.append(b"".join([self.bare[first] if len(first) < LONG else self.ids(first), *map(self.spaced.__getitem__, cuts), self.end]))
            if self.taken > MEMORY:
                self.bare.old = self.spaced.old = {}
                self.taken, self.bare, self.spaced = 0, _Cuts(self, "", self.bare), _Cuts(self, " ", self.spaced)
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


BLOCKS = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()),
     ("used", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
)
BLOCKS_DDL = "part bigint, seq bigint, ids array<bigint>, sizes array<bigint>, tokens binary, used array<int>, times array<bigint>"


def _tokenising(path: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        width = np.dtype(enc.kind).itemsize
        ids: list = []
        parts: list[bytes] = []
        total = 0

        def packed():
            data = b"".join(parts)
            n = np.bincount(np.frombuffer(data, enc.kind))
            used = np.flatnonzero(n)
            row = {"part": part, "seq": seq, "ids": ids, "sizes": [len(p) // width for p in parts], "tokens": zstandard.compress(data, 1), "used": used, "times": n[used]}
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(docs), 500):
                for d, t in zip(docs[at : at + 500], enc.encode([t or "" for t in texts.slice(at, 500).to_pylist()]), strict=True):
                    ids.append(d)
                    parts.append(t)
                    total += len(t) // width
                    if total >= block_ids:
                        yield packed()
                        ids, parts, total, seq = [], [], 0, seq + 1
        if ids:
            yield packed()

    return run


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64)
    is_leaf, weights = [], np.empty(0)
    for _ in range(limit):
        both = np.r_[w, weights]
        at = np.argsort(both, kind="stable")
        is_leaf.append(at < len(w))
        both = both[at]
        weights = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * len(w) - 2, np.zeros(len(w), np.int64)
    for leaf in reversed(is_leaf):  # of what is taken of a level, leaves get a bit and packages take two of the level below
        n = int(leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, of one length in the order of ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint64)
        self.bits = int(lengths.max(initial=1))
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(lengths[ids], kind="stable")]
        room = np.uint64(1) << (np.uint64(self.bits) - self.lengths[ids])  # entries of the table that a code takes
        firsts = np.r_[np.uint64(0), np.cumsum(room)[:-1]].astype(np.uint64) if len(ids) else np.empty(0, np.uint64)
        self.left = np.zeros(len(lengths), np.uint64)  # codes from the highest bit on
        self.left[ids] = firsts << np.uint64(64 - self.bits)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        filled = np.repeat(ids.astype(np.uint32), room.astype(np.int64))
        self.symbol[: len(filled)] = filled
        self.short = lengths.astype(np.uint8)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every STRIDE-th id."""
        out, offsets, base = [], [], 0
        for at in range(0, len(ids), SEGMENT):
            seg = ids[at : at + SEGMENT]
            words = np.zeros(int(self.short[seg].sum(dtype=np.int64) >> 6) + 2, np.uint64)
            end = 0
            for k in range(0, len(seg), RUN):
                run = seg[k : k + RUN]
                n = self.lengths[run]
                ends = np.cumsum(n)
                starts = ends - n + np.uint64(end)
                word = (starts >> np.uint64(6)).view(np.int64)
                shift = starts & np.uint64(63)
                code = self.left[run]
                firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                words[word[firsts]] += np.add.reduceat(code >> shift, firsts)  # no two share a bit
                over = np.flatnonzero(shift + n > np.uint64(64))
                words[word[over] + 1] += code[over] << (np.uint64(64) - shift[over])
                offsets.append(starts[::STRIDE].view(np.int64) + 8 * base)
                end += int(ends[-1])
            size = -(-end // 8)
            out.append(words.astype(">u8").tobytes()[:size])
            base += size
        return b"".join(out), np.concatenate(offsets) if offsets else np.empty(0, np.int64)

    def decode(self, data: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        """All ids; stretches between checkpoints side by side, a segment at a time."""
        out = np.empty(count, np.uint32)
        per = SEGMENT // STRIDE
        mask, bits = np.uint32((1 << self.bits) - 1), self.bits
        for k in range(0, len(offsets), per):
            at = offsets[k : k + per]
            low = int(at[0]) >> 3
            high = (int(offsets[k + per]) >> 3) if k + per < len(offsets) else len(data)
            b = np.frombuffer(data[low:high] + b"\0" * 4, np.uint8).astype(np.uint32)
            windows = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
            pos = at - 8 * low
            n = min(SEGMENT, count - k * STRIDE)
            lanes = np.zeros((STRIDE, len(pos)), np.uint32)
            last = n - (len(pos) - 1) * STRIDE  # ids of the last stretch
            for i in range(min(STRIDE, n)):
                if i == last:
                    pos = pos[:-1]
                if not len(pos):
                    break
                x = (windows[pos >> 3] >> (32 - bits - (pos & 7)).astype(np.uint32)) & mask
                s = self.symbol[x]
                lanes[i, : len(pos)] = s
                pos = pos + self.short[s]
            out[k * STRIDE : k * STRIDE + n] = lanes.T.reshape(-1)[:n]
        return out


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _writing(root: str, lengths: bytes, kind: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        fs.create_dir(folder)
        code = Code(np.frombuffer(lengths, np.uint8))
        packed = zstandard.compress(lengths, 3)
        head = MAGIC + struct.pack("<I", len(packed)) + packed
        out = name = temporary = None
        rows, last, size = [], None, 0

        def close():
            out.close()
            fs.move(temporary, f"{folder}/{name}")  # whole files only, whichever attempt comes first

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["part"], row["seq"])
                if out is None or here != (last[0], last[1] + 1) or size >= file_bytes:
                    if out is not None:
                        close()
                    name = f"{here[0]:08d}-{here[1]:08d}.huf"
                    temporary = f"{folder}/{name}.{uuid.uuid4().hex}"
                    out, size = fs.open_output_stream(temporary, compression=None), len(head)
                    out.write(head)
                    rows.append({"part": here[0], "seq": here[1], "name": name, "docs": 0, "ids": 0, "bytes": size})
                ids = np.frombuffer(zstandard.decompress(row["tokens"]), kind)
                bits, offsets = code.encode(ids)
                named = np.array([d is not None for d in row["ids"]], np.uint8)
                docs = np.array([d or 0 for d in row["ids"]], "<i8")
                data = struct.pack("<4Q", len(docs), len(ids), len(offsets), len(bits))
                data += docs.tobytes() + named.tobytes() + np.array(row["sizes"], "<u8").tobytes() + offsets.astype("<u8").tobytes() + bits
                out.write(data)
                size += len(data)
                rows[-1]["docs"] += len(docs)
                rows[-1]["ids"] += len(ids)
                rows[-1]["bytes"] = size
                last = here
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(rows, schema=MANIFEST)

    return run


MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
MANIFEST_DDL = "part bigint, seq bigint, name string, docs bigint, ids bigint, bytes bigint"


def read_file(f) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block: doc_ids, whether they are there, numbers of ids, ids."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of this format")
    code = Code(np.frombuffer(zstandard.decompress(f.read(struct.unpack("<I", f.read(4))[0])), np.uint8))
    while head := f.read(32):
        docs, count, marks, size = struct.unpack("<4Q", head)
        ids, named = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(docs), np.uint8)
        sizes, offsets = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64), np.frombuffer(f.read(8 * marks), "<u8").astype(np.int64)
        yield ids, named, sizes, code.decode(f.read(size), offsets, count)


DECODED_DDL = "name string, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def _reading(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                before = 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for docs, named, sizes, ids in read_file(f):
                        data = memoryview(ids.astype("<u4").tobytes())
                        ends = np.cumsum(sizes)
                        crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        columns = [
                            pa.array([name] * len(docs), pa.string()), pa.array(docs, pa.int64(), mask=named == 0),
                            pa.array(ends - sizes + before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "before", "n_tokens", "ids_crc32"])
                        before += int(sizes.sum())

    return run


class TokenFiles:
    """The files of a table's token ids."""

    def __init__(self, root: str, manifest: DataFrame):
        self.root, self.manifest = root, manifest

    def read(self) -> DataFrame:
        """One row per document, in no order: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
        before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
        bases = self.manifest.select(F.col("name").alias("_n"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
        files = self.manifest.select("name").repartition(max(1, min(10_000, self.manifest.count())))
        d = files.mapInArrow(_reading(self.root), DECODED_DDL)
        d = d.join(maybe_broadcast(bases), d["name"] == bases["_n"])
        return d.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES, part_bytes: int = PART_BYTES) -> TokenFiles:
    """docs: doc_id, text. Writes the ids of all rows, in ascending order of doc_id, to files in the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    docs = docs.select("doc_id", "text")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    dealt = docs.repartitionByRange(min(PARTS, max(8, size // part_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    blocks = scratch.save(dealt.mapInArrow(_tokenising(vocabulary, block_ids), BLOCKS_DDL), "blocks", compression="none")
    del dealt
    enc = _encoder(vocabulary)
    counts = np.zeros(max(enc.size, END_ID + 1), np.int64)
    found = blocks.select(F.explode(F.arrays_zip("used", "times")).alias("x")).groupBy("x.used").agg(F.sum("x.times").alias("n"))
    for r in found.collect():  # a row an id of the vocabulary at most
        counts[r["used"]] = r["n"]
    lengths = code_lengths(counts, limit).tobytes()
    root = scratch.path("files")
    parts = blocks.select("part", "seq", "ids", "sizes", "tokens")
    manifest = scratch.save(parts.mapInArrow(_writing(root, lengths, np.dtype(enc.kind).str, file_bytes), MANIFEST_DDL), "manifest")
    scratch.drop("blocks")
    return TokenFiles(root, manifest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_FILE)).read()
