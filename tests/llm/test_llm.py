"""The training-data operators against SQL, brute force and laws, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from folioflow.llm import common, decontamination, mixing, near_dedup, quality_rules, queries, sharding, substring_dedup, token_counts, token_output, url_filters, warc
from folioflow.llm.common import Scratch
from folioflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("rid", "n", "words", "key", "shard", "print", "term", "terms", "_t", "_key", "_row", "size", "block", "sampled", "probability", "n_tokens", "topic", "kept")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def odd(spark):
    """Nulls, empty, white and repeated texts, repeated and missing ids, a long text, clashing columns."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    text = " ".join(f"the{i} of and" for i in range(60))
    data = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, text), (4, text), (5, text), (None, text), (6, text + " end"), (7, "x"), (8, long), (9, long.upper())]
    d = spark.createDataFrame([(i, t, None if i == 5 else "en", "s", 0) for i, t in data], DOCS)
    return d.withColumns({c: F.lit(c) for c in CLASHING})


def empty(spark):
    return odd(spark).limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, duck, same, name):
    same(queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLES[name]))


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_near_dedup", "op7_mixing", "op8_warc", "op10_url_filters"])
def test_without_broadcasts(spark, sf, duck, same, monkeypatch, name):
    """What is too large to broadcast is shuffled, with the same results."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    same(queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLES[name]))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookups_of_any_size(spark, monkeypatch, how):
    """A hot key, a null key and keys that are not there: broadcast and dealt lookups agree, and no row is lost or doubled."""
    d = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"))
    lookup = spark.createDataFrame([(1, "hot"), (2, "two"), (5000, "none")], "k long, name string")
    want = Counter(map(tuple, common.looked_up(d, lookup, ["k"], "id", how=how).select(*(["id", "name"] if how in ("inner", "left") else ["id"])).collect()))
    assert len(want) == {"inner": 336, "left": 1000, "left_semi": 336, "left_anti": 664}[how]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 3)
    assert not common.small(lookup)
    got = common.looked_up(d, lookup, ["k"], "id", how=how).select(*(["id", "name"] if how in ("inner", "left") else ["id"])).collect()
    assert Counter(map(tuple, got)) == want


def test_shared_folder_is_named_on_clusters(monkeypatch):
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://x:7077"})

    with pytest.raises(ValueError, match="must name a folder"):
        common.shared_root(Session())
    Session.conf = Conf({"spark.master": "local[2]"})
    assert common.shared_root(Session()).startswith("file://") and "spark.checkpoint.dir" in Session.conf


# 1


def test_phrases_and_proximity(spark):
    d = spark.createDataFrame([(1, "a b c a b d"), (2, "c b a"), (3, None)], "doc_id long, text string")
    s = Scratch(spark, "t")
    index = decontamination.build_index(d, None, s)
    ids = {r["rid"]: r["doc_id"] for r in index.rows.collect()}
    wanted = spark.createDataFrame([(["a", "b"], 1), (["b", "d"], 2), (["b", "x"], 3)], "words array<string>, w int")
    got = sorted((ids[r["rid"]], r["start"], r["w"]) for r in decontamination.phrases(index, wanted, s).collect())
    assert got == [(1, 0, 1), (1, 3, 1), (1, 4, 2)]
    near = decontamination.proximity(index, spark.createDataFrame([("a", "c")], "a string, b string"), 2, s)
    assert sorted((ids[r["rid"]], r["at_a"], r["at_b"]) for r in near.collect()) == [(1, 0, 2), (1, 3, 2), (2, 2, 0)]


def test_proximity_is_brute_force(spark):
    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 5, 40, 200)]
    s = Scratch(spark, "t")
    index = decontamination.build_index(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), None, s)
    ids = {r["rid"]: r["doc_id"] for r in index.rows.collect()}
    pairs = [("a", "b"), ("a", "a"), ("c", "z")]
    want = Counter((k, a, b, i, j) for k, t in enumerate(texts) for a, b in pairs for i, x in enumerate(t) for j, y in enumerate(t) if i != j and x == a and y == b and abs(i - j) <= 3)
    got = decontamination.proximity(index, spark.createDataFrame(pairs, "a string, b string"), 3, s)
    assert Counter((ids[r["rid"]], r["a"], r["b"], r["at_a"], r["at_b"]) for r in got.collect()) == want


def test_index_holds_lists_by_term(spark):
    d = spark.createDataFrame([(1, "(A) b, a!"), (2, None), (3, "...")], "doc_id long, text string")
    index = decontamination.build_index(d, spark.createDataFrame([("a",), ("c",)], "word string"), Scratch(spark, "t"))
    term = {r["word"]: r["term"] for r in index.terms.collect()}
    rows = {r["rid"]: (r["doc_id"], r["n_words"]) for r in index.rows.collect()}
    assert sorted(rows.values()) == [(1, 3), (2, 0), (3, 0)]
    assert sorted((rows[r["rid"]][0], r["term"], r["pos"]) for r in index.postings.collect()) == [(1, term["a"], 0), (1, term["a"], 2)]


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "THE1 of, and"), (1, "THE1 of, and"), (2, None), (3, ""), (None, "w1")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in decontamination.contamination(odd(spark), items).collect()}
    assert got[4, 180] == (3, ["1"]) and got[None, 0] == (0, []) and got[3, 0] == (0, []) and got[8, 60_000][0] > 0
    assert decontamination.contamination(empty(spark), items).count() == 0
    assert decontamination.contamination(odd(spark), items.limit(0)).where("n_hit > 0").count() == 0
    left = decontamination.drop_contaminated(odd(spark), items)
    assert left.columns == odd(spark).columns and Counter(r["doc_id"] for r in left.collect()) == Counter([None, 1, 2, 3, 7])


# 2


def test_near_dedup_is_brute_force(spark, sf, rows):
    assert Counter(map(tuple, near_dedup.query(spark, sf).collect())) == brute.near(rows)


def test_near_dedup_of_chains_and_hubs(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    texts = [list(base)]
    for _ in range(60):  # copies of copies: links follow chains
        t = list(rng.choice(texts))
        t[rng.randrange(150)] = f"x{rng.random()}"
        texts.append(t)
    passage = [f"p{i}" for i in range(30)]
    texts += [[f"o{k}-{i}" for i in range(40)] + passage for k in range(40)]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute.near(data)
    for part in (near_dedup.LIST_PART, 7):  # long lists in parts, or not
        monkeypatch.setattr(near_dedup, "LIST_PART", part)
        got = near_dedup.group(spark.createDataFrame(data, "doc_id long, text string")).drop("text_key")
        assert Counter(map(tuple, got.collect())) == want


def test_near_dedup_edges(spark):
    got = near_dedup.group(odd(spark)).drop("text_key")
    want = brute.near([tuple(r) for r in odd(spark).select("doc_id", "text").collect()])
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()}
    assert by[5, 178] == 4 and by[None, 178] == 4 and by[6, 179] == 4 and by[9, by_n(want, 9)] == 8 and by[2, 0] == 2 and by[3, 0] == 3
    assert near_dedup.group(empty(spark)).count() == 0
    left = near_dedup.drop_copies(odd(spark))
    assert left.columns == odd(spark).columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([None, 1, 2, 3, 4, 4, 7, 8])


def by_n(want, doc):
    return next(k[1] for k in want if k[0] == doc)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_filter_is_as_sure_as_its_lists(spark, percent):
    k = near_dedup.K
    m = near_dedup.least_seen(percent, k)
    tail = lambda m: sum(math.comb(k, j) * (percent / 100) ** j * (1 - percent / 100) ** (k - j) for j in range(m))
    assert tail(m) <= near_dedup.MISS < tail(m + 1)
    # a pair at the threshold that shares just m of the union's k smallest hashes, and one that shares fewer
    link = near_dedup.Linker.__new__(near_dedup.Linker)
    link.scratch, link.size, link.percent = Scratch(spark, "t"), 3, percent
    sets = {}
    for i, seen in enumerate((m, m - 1)):
        alone = [*range(1, k - seen + 1), *range(900, 900 + 10 * (100 - percent) - k + seen)]
        sets[2 * i] = np.arange(1, 1001, dtype=np.uint64)
        sets[2 * i + 1] = np.array([h for h in range(1, 1001) if h not in alone], np.uint64)
    link.sketches = spark.createDataFrame([(c, x[:k].astype(np.int64).tolist()) for c, x in sets.items()], "cid long, sketch array<long>")
    link.sets = spark.createDataFrame([(c, bytearray(x.tobytes())) for c, x in sets.items()], "cid long, shingles binary")
    got = link.verified(spark.createDataFrame([(0, 1), (2, 3)], "a long, b long"), "pairs")
    assert [tuple(r) for r in got.collect()] == [(0, 1)]


@pytest.mark.parametrize("hub", [None, 3])
def test_components(spark, monkeypatch, hub):
    if hub:
        monkeypatch.setattr(sys.modules[components.__module__], "HUB", hub)
    chain = [(i, i + 1) for i in range(100, 200)] + [(1, 2), (5, 2), (300, 300)] + [(1000, i) for i in range(1001, 1040)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 100 for i in range(100, 201)}, 1: 1, 2: 1, 5: 1, **{i: 1000 for i in range(1000, 1040)}}


# 3


def test_shards_are_even_and_keep_links(spark, docs):
    d = docs.select("doc_id", "text").unionByName(docs.limit(20).select("doc_id", "text")).unionByName(docs.where("doc_id < 3").select("doc_id", "text"))
    d = d.unionByName(spark.range(300).select("id", F.lit("hot text")).toDF("doc_id", "text"))
    placed = sharding.place(d).persist()
    rows = placed.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == d.count() and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the hot link does not fit in a shard: at best it fills one after the other; small links need no cut
    is_hot = F.col("text_crc32") == F.lit(zlib.crc32(b"hot text"))
    room, left, least = sorted(sizes.values(), reverse=True), 300, math.comb(300, 2)
    for n in room:
        least -= math.comb(min(n, left), 2)
        left -= min(n, left)
    assert least <= sharding.cut_links(placed.where(is_hot)) <= 1.01 * least
    assert sharding.cut_links(placed.where(~is_hot)) <= 0.1 * sharding.cut_links(placed.where(~is_hot), "start_shard")
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in d.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts


def test_sharding_edges(spark):
    rows = sharding.digest(sharding.place(odd(spark))).collect()
    assert len(rows) == 12 and {r["law"] for r in rows} == {"rows"}
    assert sorted((r["size"], r["text_crc32"]) for r in rows)[:3] == [(1, 0)] * 3
    assert sharding.place(empty(spark)).count() == 0


@pytest.mark.parametrize("case", ["pairs", "groups", "one large"])
def test_links_of_full_shards_are_joined(spark, case):
    """Every document has a copy, so that all shards are full of linked rows from the start."""
    text = {"pairs": F.expr("id div 2"), "groups": F.expr("floor(sqrt(id * 30))"), "one large": F.expr("if(id % 3 = 0, -1, id div 6)")}[case]
    d = spark.range(6000).select(F.col("id").alias("doc_id"), text.cast("string").alias("text"))
    placed = sharding.place(d).persist()
    sizes = Counter(r["shard"] for r in placed.select("shard").collect())
    assert sum(sizes.values()) == 6000 and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    small = placed.where("text_crc32 != crc32(encode('-1', 'UTF-8'))")
    assert sharding.cut_links(small) <= 0.03 * sharding.cut_links(small, "start_shard")
    if case == "one large":  # 2000 rows in shards of 750: two full ones and the rest in a third
        n = sorted((r["count"] for r in placed.where("text_crc32 = crc32(encode('-1', 'UTF-8'))").groupBy("shard").count().collect()), reverse=True)
        assert sum(n[:3]) >= 0.97 * 2000


def test_flows_keep_shards_in_size():
    rng = random.Random(5)
    for _ in range(300):
        k = rng.randrange(2, 9)
        demand = {(s, t): rng.randrange(100) for s in range(k) for t in range(k) if s != t and rng.random() < 0.5}
        room, spare = [rng.randrange(-20, 40) * rng.randrange(2) for _ in range(k)], [rng.randrange(60) for _ in range(k)]
        flow, way = sharding.flows(demand, room, spare)
        assert all(0 <= flow[s][t] <= demand.get((s, t), 0) for s in range(k) for t in range(k))
        for j in range(k):
            into, out = sum(x[j] for x in flow) + sum(x[j] for x in way), sum(flow[j]) + sum(way[j])
            assert into - out <= max(0, room[j]) and sum(way[j]) <= spare[j]
    assert sharding.flows({(0, 1): 5, (1, 2): 3, (2, 0): 4}, [0] * 3, [0] * 3)[0] == [[0, 3, 0], [0, 0, 3], [3, 0, 0]]


# 4


def test_substring_dedup_is_brute_force(spark, sf, rows):
    assert Counter(map(tuple, substring_dedup.query(spark, sf).collect())) == brute.repeats(rows)


def test_substring_dedup_over_blocks(spark):
    rng = random.Random(2)
    shared = [[f"s{k}-{i}" for i in range(n)] for k, n in enumerate((34, 35, 36, 60, 120))]
    data = []
    for d in range(40):
        t = []
        for _ in range(5):
            t += [f"u{rng.random()}" for _ in range(rng.randrange(20))] + rng.choice(shared)
        data.append((d, " ".join(t)))
    data += [(40, "a " * 100), (41, "a " * 35), (None, None), (42, "b " * 35)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = substring_dedup.remove_repeats(d, block_bytes=2_000).persist()
    bundled = substring_dedup.remove_repeats(d, block_bytes=1_000, bundle=3, texts=False)
    assert Counter(map(tuple, bundled.collect())) == brute.repeats(data)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute.repeats(data)
    r = got.where("doc_id = 40").first()
    assert r["kept_text"] == "" and [tuple(s) for s in r["spans"]] == [(0, 100)]


def test_automata_decide(tmp_path):
    """Marks come from what the automaton finds of other places' words, not from what digests claimed."""
    import pyarrow as pa
    import zstandard

    texts = [b"a b c d e", b"x a b c", b"q b c d e"]
    data = zstandard.compress(b"".join(texts))
    (tmp_path / "f").write_bytes(data)
    block = pa.Table.from_pylist([{"block": 7, "ids": [1, 2, 3], "lengths": list(map(len, texts)), "name": "f", "at": 0, "bytes": len(data)}])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def removed(*lent):
        rows = [{"block": 7, "source": source, "at": at, "words": zstandard.compress(words)} for source, at, words in lent]
        passages = pa.Table.from_pylist(rows, schema=substring_dedup.PASSAGES)
        return substring_dedup._removing(f"file://{tmp_path}", False, schema)(block, passages).column("n_removed").to_pylist()

    assert removed() == [0, 0, 0]
    assert removed((9, [4], b"a b c")) == [3, 3, 0]  # lent by another block
    assert removed((9, [4, 8], b"a b z\nb c d e")) == [4, 0, 4]  # what does not stand here word by word marks nothing
    assert removed((7, [0], b"a b c")) == [3, 3, 0]  # lent by the first text, found in the second
    assert removed((7, [9], b"q b c d e")) == [0, 0, 0]  # found at no other place than the one that lent it
    assert removed((7, [0, 5], b"a b c\na b c")) == [3, 3, 0] and removed((7, [0], b"a b c d e"), (8, [0], b"a b c d e")) == [5, 0, 0]


def test_substring_dedup_edges(spark):
    got = Counter(map(tuple, substring_dedup.remove_repeats(odd(spark), texts=False).collect()))
    assert got == brute.repeats([tuple(r) for r in odd(spark).select("doc_id", "text").collect()])
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


# 5


def brute_tokens(m, word):
    s, best = token_counts.MARK + word, {0: (0, 0)}
    for e in range(1, len(s) + 1):
        width = len(s[e - 1].encode())
        options = [(best[e - 1][0] + m.unknown * width, best[e - 1][1] - width)]
        options += [(best[a][0] + m.scores[s[a:e]], best[a][1] - 1) for a in range(e) if s[a:e] in m.scores]
        best[e] = max(options)
    return -best[len(s)][1]


def test_token_counts_are_brute_force(spark, sf, rows):
    import public_tokenizers

    m = token_counts.Unigram.load(public_tokenizers.path(token_counts.VOCABULARY_FILE))
    known = {}
    want = Counter()
    for d, t in rows[:60]:
        ws = brute.words(t)
        for w in ws:
            known[w] = known.get(w) or brute_tokens(m, w)
        want[d, len(ws), sum(known[w] for w in ws)] += 1
    got = Counter(map(tuple, token_counts.query(spark, sf).where(F.col("doc_id").isin([d for d, _ in rows[:60]])).collect()))
    assert got == want
    assert token_counts.Unigram(["a", "▁", "ab", "b"]).count(["ab", "abab", "é", ""]) == {"": 1, "ab": 2, "abab": 3, "é": 3}


def test_token_counts_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path(token_counts.VOCABULARY_FILE)
    got = token_counts.count_tokens(odd(spark), path).collect()
    assert len(got) == 12 and [tuple(r) for r in got if r["doc_id"] in (1, 2, 3)] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert token_counts.count_tokens(empty(spark), path).count() == 0
    total = {r["lang"]: r["n_docs"] for r in token_counts.totals(odd(spark), path, "lang").collect()}
    assert total == {"en": 11, None: 1}


# 6


def test_token_files_round_trip(spark, sf, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_output.VOCABULARY_FILE)
    tok, start, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, token_output.END_ID]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.query(spark, sf).collect())) == want
    small = token_output.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, block_ids=700, file_bytes=9_000)
    assert small.manifest.count() > 8 and sorted(map(tuple, small.read().collect())) == want
    e = token_output.Encoder(path)
    for t in ("a  b", "a \nb", " a b ", "<|endoftext|> x", "a\u00a0b  c", "", "  ", "x\x1c y \x1cz", "it's 's  'll", "tab\t x", "é ü\n\n  z", "a \u200bb"):
        assert np.frombuffer(e.encode([t])[0], e.kind).tolist() == [*tok.encode(t, add_special_tokens=False).ids, token_output.END_ID]


@pytest.mark.parametrize("counts", [[0, 0, 5], [1, 1], [2**i for i in range(40)], [1] * 1000, [0] * 5])
def test_huffman(counts):
    import heapq

    counts = np.array(counts, np.int64)
    n = token_output.code_lengths(counts, 12)
    used = counts > 0
    assert (n[~used] == 0).all() and n.max(initial=0) <= 12
    if used.sum() > 1:
        assert math.isclose(sum(2.0 ** -int(x) for x in n[used]), 1)
    wide = token_output.code_lengths(counts, 60)
    heap, cost = [int(c) for c in counts[used]], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    if used.sum() > 1:
        assert int((wide * counts).sum()) == cost
    if used.any():
        ids = np.random.default_rng(1).choice(np.flatnonzero(used), 5000).astype(np.uint16)
        code = token_output.Code(n)
        data, marks = code.encode(ids)
        assert (code.decode(data, marks, len(ids)) == ids).all()


def test_first_cuts_are_remembered_and_long_ones_parted_by_the_library(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_output.VOCABULARY_FILE)
    tok, e, calls = Tokenizer.from_file(path), token_output.Encoder(path), []
    monkeypatch.setattr(e, "ids", lambda text, ids=e.ids: calls.append(text) or ids(text))
    starts = ["Some", "some,", "a\nb", "Éte", "a\n\nb", "\nb", "b\n", "\u00a0x", "4.0.", "...", "", "x" * 300, "a\tb", "ǅ", "a\nb\nc,"]
    texts = [f"{s} words" for s in starts] + starts + ["\n".join(["ab"] * 5000), "x " + "\n".join(["ab"] * 5000)]
    for _ in range(2):
        got = [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)]
        assert got == [[*tok.encode(t, add_special_tokens=False).ids, token_output.END_ID] for t in texts]
    calls.clear()
    e.encode(["Some words here"] * 50)
    assert not calls


def test_token_files_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path(token_output.VOCABULARY_FILE)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"]) for r in token_output.write_tokens(odd(spark), path).read().collect()), key=lambda r: r[2])
    assert len(got) == 12 and got[0][3] == 1 and [r[1] for r in got] == sorted((r[1] for r in got), key=lambda d: (d is not None, d or 0))
    assert [r[2] for r in got] == np.cumsum([0, *(r[3] for r in got)])[:-1].tolist()
    assert token_output.write_tokens(empty(spark), path).read().count() == 0


# 7


def test_raking_meets_its_targets(spark, sf):
    d = mixing.query(spark, sf).collect()
    tokens = defaultdict(float)
    drawn = defaultdict(float)
    for r in d:
        for dim in mixing.DIMS:
            tokens[dim, r[dim]] += r["n_tokens"]
            drawn[dim, r[dim]] += r["n_tokens"] * r["probability"]
    for dim, power in mixing.TEMPER.items():
        target = {v: t**power for (k, v), t in tokens.items() if k == dim}
        total, all_drawn = sum(target.values()), sum(x for (k, _), x in drawn.items() if k == dim)
        for v, t in target.items():
            assert abs(drawn[dim, v] / all_drawn - t / total) < 1e-5
    assert max(r["probability"] for r in d) == 1 and all(r["margins_met"] for r in d)
    for r in d:
        u = int(hashlib.md5(f"{r['doc_id']}#{mixing.SEED}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r["sampled"] == (u < r["probability"])
    cells = {(r["source"], r["lang"], r["topic"]): 0.0 for r in d}
    for r in d:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    w = dict(cells)
    for _ in range(mixing.ROUNDS):  # the same in plain Python
        for i, dim in enumerate(mixing.DIMS):
            t = defaultdict(float)
            now = defaultdict(float)
            for k, n in cells.items():
                t[k[i]] += n
                now[k[i]] += w[k]
            t = {k: n ** mixing.TEMPER[dim] for k, n in t.items()}
            total = sum(t.values())
            w = {k: x * t[k[i]] / total / now[k[i]] if now[k[i]] else 0.0 for k, x in w.items()}
    f = {k: w[k] / cells[k] if cells[k] else 0.0 for k in w}
    assert all(abs(r["probability"] - f[r["source"], r["lang"], r["topic"]] / max(f.values())) < 1e-4 for r in d)


def test_raking_of_many_cells(spark, sf, monkeypatch):
    want = {r["doc_id"]: r for r in mixing.query(spark, sf).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = mixing.query(spark, sf).collect()
    assert len(got) == len(want) and all(abs(r["probability"] - want[r["doc_id"]]["probability"]) < 1e-8 for r in got)


def test_raking_tells_what_it_cannot_meet(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "p string, q string, tokens long")
    share = lambda *rows: spark.createDataFrame(rows, "value string, share double")
    got = mixing.rake(cells, {"p": share(("a", 0.5), ("b", 0.5)), "q": share(("x", 0.9), ("y", 0.1))}, rounds=8).collect()
    assert {round(r["margin_error"], 3) for r in got} == {0.4}


def test_mixing_edges(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == 12 and all(0 <= r["probability"] <= 1 for r in got) and {r["_mix_topic"] for r in got} == {"brief", "article", "long"}
    assert len({r["sampled"] for r in got if r["doc_id"] == 4}) == 1
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(odd(spark).where("doc_id < 3")).where("probability > 0").count() == 0


# 8


@pytest.mark.parametrize("compress", [True, False])
def test_chains_reject_magic_in_payloads(spark, compress):
    fake = warc.record(99, "http://fake", b"trap", "X" * 32, None, False).decode()
    pages = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, fake), (4, "http://d", fake + fake), (5, "u", None), (6, "u", ""), (None, "u", "same"), (7, "u", "é" * 200_000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    s = Scratch(spark, "t")
    root, manifest = warc.write_archives(d.coalesce(1), s, compress=compress, file_bytes=5_000)
    rows = [tuple(r) for r in warc.read_archives(root, manifest, s, stretch=700).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    n = len(fake)
    want = [(1, 4, "revisit", 2), (2, 4, "response", None), (3, n, "response", None), (4, 2 * n, "response", None), (5, 0, "revisit", 6), (6, 0, "response", None), (None, 4, "revisit", 2), (7, 400_000, "response", None)]
    assert Counter(rows) == Counter(want)


def test_warc_heads_of_any_length_and_lost_records(spark):
    url = "http://x/" + "y" * (2 * warc.READ + 5)
    d = spark.createDataFrame([(1, url, "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1)
    s = Scratch(spark, "t")
    root, manifest = warc.write_archives(d, s, compress=False)
    assert sorted((r["page_id"], r["url"]) for r in warc.read_archives(root, manifest, s).collect()) == [(1, url), (2, "u")]
    file = Path(root.removeprefix("file://")) / manifest.first()["name"]
    file.write_bytes(file.read_bytes()[:-20])
    with pytest.raises(ValueError, match="does not hold"):
        warc.read_archives(root, manifest, Scratch(spark, "t"))


def test_warc_least_and_empty(spark):
    d = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    s = Scratch(spark, "t")
    root, manifest = warc.write_archives(d, s, least=3)
    assert warc.read_archives(root, manifest, s).where("record_type = 'revisit'").count() == 0
    root, manifest = warc.write_archives(d.limit(0), Scratch(spark, "t2"))
    assert warc.read_archives(root, manifest, Scratch(spark, "t3")).count() == 0


# 9


def test_quality_edges(spark):
    got = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.measure(odd(spark).where("doc_id IS NOT NULL"))).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and not got[3]["kept"]
    assert got[4]["n_words"] == 180 and got[4]["n_repeat_words"] == 0
    assert quality_rules.measure(empty(spark)).count() == 0
    kept = quality_rules.keep_good(odd(spark))
    assert kept.columns == odd(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([4, 4, 5, None, 6])  # rows 8 and 9 have no stop words


def test_quality_results_can_be_filtered(spark, sf):
    d = quality_rules.query(spark, sf)
    rows = d.collect()
    for column in ("kept", "base_failed"):
        assert d.where(column).count() == sum(r[column] for r in rows)
    assert d.where("n_repeat_words > 10").count() == sum(r["n_repeat_words"] > 10 for r in rows)


def test_repeated_windows_by_both_ways(spark):
    rng = random.Random(4)
    data = [(k, " ".join(rng.choice("abcdefgh"[: 2 + k % 7]) for _ in range(n))) for k, n in enumerate([3, 4, 10, 60, 200, 900, 3000] * 3)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measure(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for k, t in data:
        w = t.split()
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert got[k] == len({j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})


def test_quality_rules_know_the_labels(spark, sf):
    d = quality_rules.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert d.where("quality = 1 AND NOT kept AND NOT base_failed").count() == 0
    assert d.where("quality = 0 AND kept").count() == 0


# 10


def test_url_rules(spark):
    urls = ["http://a.org/x", "http://example.org/es/1", "http://m.EXAMPLE.org/en/12?q", "http://example.org/en/2", "http://badexample.org/es/", "http://x.com/fr/", "http://x.com/de/a", "http://x.com/DE/", "http://org", "a.org/x", None, "x://org/://b", "http://notorg/"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r["host"], r["path"], r["rule"]) for r in url_filters.parsed(d).orderBy("page_id").collect()]
    assert got == [
        ("a.org", "/x", "org/"), ("example.org", "/es/1", "example.org/es/"), ("m.example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"),
        ("badexample.org", "/es/", "org/"), ("x.com", "/fr/", "com/fr/"), ("x.com", "/de/a", "com/de/"), ("x.com", "/DE/", None), ("org", "", None), ("", "", None),
        ("", "", None), ("org", "/://b", "org/"), ("notorg", "/", None),
    ]


def test_url_model_is_brute_force(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    data = list({(word("abcd"), True) for _ in range(80)} | {(word("cdef"), False) for _ in range(80)})
    labelled = spark.createDataFrame(data, "s string, good boolean")
    model = url_filters.train(labelled, Scratch(spark, "t"))
    counts = {k: Counter() for k in (True, False)}
    for s, good in data:
        t = "\x01" + s
        for i in range(1, len(t)):
            counts[good].update(t[i - k : i + 1] for k in range(min(url_filters.ORDER, i) + 1))
    seen = set(counts[True]) | set(counts[False])
    totals = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            totals[k][g[:-1]] += n

    def p(kind, g):
        below = p(kind, g[1:]) if len(g) > 1 else 1 / url_filters.ALPHABET
        return (counts[kind][g] + url_filters.WEIGHT * below) / (totals[kind][g[:-1]] + url_filters.WEIGHT)

    # full likelihoods of the longest seen context, also of texts with characters and turns that were never seen
    want = {s: 0.0 for s in [*(s for s, _ in data), *(word("abcdefgh") for _ in range(50)), "", "zzz", "aéa"]}
    contexts = {g[:-1] for g in seen}
    for s in want:
        t = "\x01" + s
        for i in range(1, len(t)):
            g = next(t[i - k : i + 1] for k in range(min(url_filters.ORDER, i), -1, -1) if t[i - k : i] in contexts)
            want[s] += math.log(p(True, g)) - math.log(p(False, g))
    got = {r["s"]: r["score"] for r in url_filters.scored(spark.createDataFrame([(s,) for s in want], "s string"), model).collect()}
    assert len(got) == len(want)
    assert all(abs(got[s] - 1e6 * x / max(1, len(s))) < 20 for s, x in want.items())
    fresh = [(word("abcd"), True) for _ in range(100)] + [(word("cdef"), False) for _ in range(100)]
    at = url_filters.threshold(labelled, model)
    scores = url_filters.scored(spark.createDataFrame(list(dict(fresh)), "string").toDF("s"), model).collect()
    assert sum((r["score"] >= at) == dict(fresh)[r["s"]] for r in scores) >= 0.9 * len(scores)


def test_url_edges(spark, sf):
    d = spark.createDataFrame([(1, None), (None, "http://q.net/"), (1, ""), (1, ""), (2, "http://q.net/" + "x" * 50_000)], "page_id long, url string")
    d = d.withColumns({c: F.lit(c) for c in ("s", "host", "path", "rule", "ruled", "row", "gram", "score", "_u")})
    assert [r["verdict"] for r in url_filters.judge(d).collect()] == ["allow"] * 5
    assert url_filters.judge(d.limit(0)).count() == 0
    got = url_filters.query(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert got.where("rule IS NULL").select("verdict").distinct().count() >= 1


# the pipeline


def test_pipeline_is_its_stages(spark, sf, duck, docs):
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality_rules.judged_sql('documents')}) WHERE kept").fetchall()}
    stage = docs
    stage = corpus_pipeline.quality(spark, stage, sf)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == kept
    near = brute.near([tuple(r) for r in stage.select("doc_id", "text").collect()], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    stage = corpus_pipeline.dedup(spark, stage, sf)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == {k[0] for k in near if k[3]}
    clean = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({decontamination.contaminated_sql('documents')}) WHERE NOT contaminated").fetchall()}
    before = {r["doc_id"] for r in stage.collect()}
    stage = corpus_pipeline.decontaminate(spark, stage, sf)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == before & clean
    drawn = {r["doc_id"] for r in mixing.mix(stage).where("sampled").collect()}
    stage = corpus_pipeline.mix(spark, stage, sf)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == drawn
    last = corpus_pipeline.run(spark, sf)
    sizes = Counter(r["shard"] for r in last.collect())
    assert {r["doc_id"] for r in last.collect()} == drawn and max(sizes.values()) - min(sizes.get(j, 0) for j in range(8)) <= 1


@pytest.mark.parametrize("rows", [None, 0])
def test_pipeline_keeps_one_row_of_each_group(spark, sf, monkeypatch, rows):
    if rows is not None:
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    one, two = (" ".join(f"{c}{i} of" for i in range(60)) for c in "ab")
    data = [(4, one), (4, one), (4, one + " end"), (5, one), (None, one), (None, two), (None, two), (None, two + " end"), (7, "x y z"), (None, None), (3, ""), (3, "")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOCS)
    left = corpus_pipeline.dedup(spark, d, sf)
    assert left.columns == d.columns
    rows = left.select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([4, None, 7, None, 3, 3])
    assert sum(bool(r["text"]) and r["doc_id"] is None and r["text"].startswith(two) for r in rows) == 1


def test_pipeline_edges(spark, sf):
    for start in (odd, empty):
        stage = start(spark)
        for name, f in corpus_pipeline.STAGES:
            columns = stage.columns
            stage = spark.createDataFrame((x := f(spark, stage, sf)).collect(), x.schema)
            assert name == "sharding" or stage.columns == columns
