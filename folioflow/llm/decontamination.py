"""Benchmark decontamination over a distributed positional inverted index of the training documents.

`build_index` stores the posting lists of the wanted terms in one pass over the texts: a row for each place at which a term
stands, with the row's number and the word's. Each part of the table is sorted by term, so that a list lies together there.
`phrases` counts the terms over the index and orders each phrase's terms by their counts. The rarest term's list, moved by
its offset, gives the starts; these are intersected with the second term's list, moved by its own; what is left meets the
lists of all other terms at once, and must be found in each. `proximity` joins the lists of two terms by blocks of words.

Results in edge cases: null and empty texts have no words and no hits; an item without words has no windows; rows that
repeat a doc_id, or have none, are judged each on its own, and repeated item_ids count once; items without an id hit
words but count as no item; empty tables give no hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, looked_up, maybe_broadcast, table

#: Words of a window.
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """The words, still in their case. Around the first and the last there may be empty ones."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def _lower(w: Column) -> Column:
    """A-Z only; ASCII words take the quicker function."""
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """items: item_id, text. The distinct phrases: words, items (sorted distinct ids as strings)."""
    d = items.select("item_id", F.filter(F.transform(_words(F.col("text")), _lower), lambda w: w != "").alias("w"))
    d = d.withColumn("n", F.least(F.array_size("w"), F.lit(size))).where("n > 0")
    d = d.select("item_id", "w", "n", F.explode(F.sequence(F.lit(1), F.array_size("w") - F.col("n") + 1)).alias("at"))
    d = d.select(F.col("item_id").cast("string").alias("item"), F.slice("w", F.col("at"), F.col("n")).alias("words"))
    return d.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


@dataclass
class Index:
    """rows: rid, n_words and what was kept of each row; postings: term (a number), rid, pos; terms: word, term."""

    rows: DataFrame
    postings: DataFrame
    terms: DataFrame

    def counts(self) -> DataFrame:
        """word, term, n: how often each term stands in the texts; only those that do."""
        n = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        return self.terms.join(n, "term").select("word", "term", "n")


def build_index(docs: DataFrame, terms: DataFrame | None, scratch: Scratch, name: str = "index", keep: tuple[str, ...] = ("doc_id",), most: int | None = None) -> Index:
    """docs: text and the columns of keep; terms: word, those to be found (`most` at most, if known); None: all words."""
    if terms is None:
        terms = docs.select(F.explode(_words(F.col("text"))).alias("w")).select(_lower(F.col("w")).alias("word"))
    terms = terms.where("word != ''").distinct().withColumn("term", F.monotonically_increasing_id())
    terms = scratch.save(terms, f"{name}-terms", most)
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(k) for k in keep)).alias("keep"), _words(F.col("text")).alias("w"))
    n = F.array_size("w")
    lead = (F.get("w", F.lit(0)) == "").cast("int")
    tail = ((n > 1) & (F.element_at("w", -1) == "")).cast("int")
    d = d.select("rid", "keep", lead.alias("lead"), (n - lead - tail).cast("long").alias("n_words"), "w")
    # one row more for each text, without a term, says what it is: both come from one pass
    d = d.select("rid", "keep", "lead", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("at", "w"))
    d = d.where("w IS NULL OR w != ''").withColumn("word", _lower(F.col("w")))
    d = looked_up(d, terms, ["word"], "rid", "at", how="left").where("term IS NOT NULL OR w IS NULL")
    is_row = F.col("w").isNull()
    d = d.select(
        "term", "rid", F.when(is_row, F.col("n_words")).otherwise(F.col("at") - 1 - F.col("lead")).cast("int").alias("pos"), F.when(is_row, F.col("keep")).alias("keep")
    )
    d = scratch.save(d.sortWithinPartitions("term"), name)
    rows = d.where("term IS NULL").select("rid", F.col("pos").cast("long").alias("n_words"), "keep.*")
    return Index(rows, d.where("term IS NOT NULL").select("term", "rid", "pos"), terms)


def _rarest_first(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds id, size, and order: the phrase's terms and their offsets, rarest first. Phrases with a term that never occurs go."""
    d = phrases.withColumn("id", F.monotonically_increasing_id())
    at = d.select("id", F.posexplode("words").alias("offset", "word"))
    lists = looked_up(at, counts, ["word"], "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("order"))
    return d.join(lists, "id").where(F.array_size("order") == F.array_size("words")).withColumn("size", F.array_size("words"))


def phrases(index: Index, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """wanted: words, distinct, and other columns. Exact matches: rid, start, size, and wanted's other columns."""
    others = [c for c in wanted.columns if c != "words"]
    wanted = scratch.save(wanted, "wanted")
    lists = scratch.save(_rarest_first(wanted, index.counts()), "lists", wanted.count())
    nth = lambda k, of: F.get("order", F.lit(k))[of]
    first = lists.select(nth(0, "term").alias("term"), nth(0, "offset").alias("offset"), nth(1, "term").alias("second"), (nth(1, "offset") - nth(0, "offset")).alias("apart"), "id", "size")
    # a term may be the rarest of many phrases: its postings meet one row of them all
    first = first.groupBy("term").agg(F.collect_list(F.struct("id", "size", "offset", "second", "apart")).alias("of"))
    starts = looked_up(index.postings, first, ["term"], "rid", "pos").select("rid", "pos", F.inline("of")).where("pos >= offset")
    starts = starts.select("rid", (F.col("pos") - F.col("offset")).alias("start"), "id", "size", F.col("second").alias("term"), (F.col("pos") + F.col("apart")).alias("pos"))
    starts = scratch.save(starts, "starts")
    second = looked_up(index.postings, starts.select("term").where("term IS NOT NULL").distinct(), ["term"], "rid", "pos", how="left_semi")
    both = starts.join(second, ["rid", "pos", "term"], "left_semi").select("rid", "start", "id", "size")
    both = scratch.save(both.unionByName(starts.where("size = 1").select("rid", "start", "id", "size")), "both")
    # the other terms' lists, in the rows that are left; every place of a phrase must be found
    rest = lists.where("size > 2").select("id", F.slice("order", F.lit(3), F.col("size")).alias("rest"))
    needed = looked_up(both.where("size > 2"), rest, ["id"], "rid", "start").select("rid", "start", "id", "size", F.inline("rest"))
    needed = needed.select("rid", "start", "id", "size", "term", (F.col("start") + F.col("offset")).alias("pos"))
    near = looked_up(index.postings, both.select("rid").distinct(), ["rid"], "pos", how="left_semi")
    full = needed.join(near, ["rid", "pos", "term"], "left_semi").groupBy("rid", "start", "id", "size").count().where("count = size - 2")
    hits = both.where("size <= 2").unionByName(full.select("rid", "start", "id", "size"))
    hits = looked_up(hits, lists.select("id", *others), ["id"], "rid", "start")
    return hits.select("rid", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), *others)


def proximity(index: Index, pairs: DataFrame, within: int, scratch: Scratch) -> DataFrame:
    """pairs: a, b. Every a and b at most `within` words apart, in any order: rid, a, b, at_a, at_b. A term is not near itself at one place."""
    counts = scratch.save(index.counts(), "counts")
    of = lambda c: counts.select(F.col("word").alias(c), F.col("term").alias(f"term_{c}"), F.col("n").alias(f"n_{c}"))
    d = pairs.distinct().join(of("a"), "a").join(of("b"), "b").withColumn("pair", F.monotonically_increasing_id())
    d = scratch.save(d.withColumn("a_rare", F.col("n_a") <= F.col("n_b")), "pairs")
    block = F.floor(F.col("pos") / (within + 1))

    def places(rare: bool) -> DataFrame:
        term = F.when(F.col("a_rare") == F.lit(rare), F.col("term_a")).otherwise(F.col("term_b"))
        lists = d.select(term.alias("term"), "pair").groupBy("term").agg(F.collect_list("pair").alias("pairs"))
        return looked_up(index.postings, lists, ["term"], "rid", "pos").select("rid", "pos", F.explode("pairs").alias("pair"))

    # the rarer term's places look into the blocks beside their own
    rare = places(True).select("rid", "pair", F.col("pos").alias("at"), F.explode(F.sequence(block - 1, block + 1)).alias("block"))
    other = places(False).select("rid", "pair", "pos", block.alias("block"))
    found = rare.join(other, ["rid", "pair", "block"]).where((F.col("pos") != F.col("at")) & (F.abs(F.col("pos") - F.col("at")) <= within))
    at = lambda c: F.when(F.col("a_rare") == F.lit(c == "a"), F.col("at")).otherwise(F.col("pos")).cast("long").alias(f"at_{c}")
    return looked_up(found, d.select("pair", "a", "b", "a_rare"), ["pair"], "rid", "pos").select("rid", "a", "b", at("a"), at("b"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: keep, n_words, spans (start and end of the runs of hit words), n_hit, items (sorted ids)."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    wanted = scratch.save(windows(items, size), "windows", 100 * items.count())
    index = build_index(docs, wanted.select(F.explode("words").alias("word")), scratch, keep=keep, most=size * wanted.count())
    hits = scratch.save(phrases(index, wanted, scratch), "hits")
    # spans that overlap or touch are one, before any are gathered
    d = hits.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    d = d.withColumn("run", F.sum("new").over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = d.groupBy("rid").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # which items: one row of each phrase and document, and then of each item and document
    found = hits.select("rid", "items").distinct().select("rid", F.explode("items").alias("item")).groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    by_doc = scratch.save(spans.join(found, "rid", "left"), "by-document", hits.count())
    scratch.keep("index", "by-document")
    d = index.rows.select("rid", *keep, "n_words").join(maybe_broadcast(by_doc), "rid", "left").drop("rid")
    nothing = F.array()
    return d.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", nothing.cast("array<string>")),
        "spans": F.coalesce("spans", nothing.cast("array<struct<start: bigint, end: bigint>>")),
    })


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without a hit. Hits depend on the text alone, so its digest names the rows to drop."""
    key = F.sha2(F.encode(F.col("text"), "UTF-8"), 256)
    found = contamination(docs.select("text", key.alias("_key")), items, size, keep=("_key",)).where("n_hit > 0").select("_key").distinct()
    found = Scratch(docs.sparkSession, "contaminated").save(found, "keys")
    d = docs.select(F.struct("*").alias("_row"), key.alias("_key"), F.monotonically_increasing_id().alias("_n"))
    return looked_up(d, found, ["_key"], "_n", how="left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.array_size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def contaminated_sql(source: str, items: str = "benchmark", size: int = WINDOW) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH b AS (SELECT item_id, {words} AS ws FROM {items}),
    bl AS (SELECT *, least({size}, len(ws)) AS l FROM b WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS k FROM bl, unnest(range(1, len(ws) - l + 2)) AS u(i)),
    d AS (SELECT *, row_number() OVER () AS rid, {words} AS ws FROM {source}),
    p AS (SELECT rid, ls.l, i, array_to_string(ws[i:i + ls.l - 1], ' ') AS k
          FROM d, (SELECT DISTINCT l FROM bw) AS ls, unnest(range(1, len(ws) - ls.l + 2)) AS u(i)),
    m AS (SELECT rid, i, l, item_id FROM p JOIN bw USING (l, k)),
    hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS w FROM m) GROUP BY rid),
    it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY rid)
    SELECT d.* EXCLUDE (ws), len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""


ORACLE_SQL = f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({contaminated_sql('documents')})"
