"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Results in edge cases: a null or empty text has no words, so every count is 0 and it fails the base rule;
rows that repeat a doc_id, or have none, are judged each on its own; columns of the input other than the
two named are ignored by `measure`, and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, white_words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at this have from or by not "
    "der die das und ist nicht von zu mit den auf ein eine im dem für sich des "
    "le la les de du des et un une est que qui dans pour sur pas en au par "
    "el los las una es por con para del se no al lo como más"
).split()
#: Up to this many distinct repeated windows membership is looked up in a list; beyond, by sorting. Same results.
LOOKUP = 64


@dataclass(frozen=True)
class Rule:
    """Rejects a text unless low * base <= 1000 * metric <= high * base; None is no bound."""

    name: str
    metric: str
    base: str
    low: int | None = None
    high: int | None = None


#: The thresholds, in thousandths. The base columns are measured counts.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2_000, high=15_000),
    Rule("symbols", "n_symbols", "n_words", high=300),
    Rule("exclamations", "n_marks", "n_words", high=300),
    Rule("stop_words", "n_stop_words", "n_words", low=10),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=500),
)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: its id, the columns of `keep`, and the counts that rules refer to."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    dropped = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    stop = F.array_size(F.filter(F.col("_w"), lambda w: F.lower(w).isin(*STOP_WORDS)))
    n = F.array_size("_w")
    d = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(k) for k in keep), F.col(text).alias("_t"))
    d = d.withColumn("_w", white_words(F.col("_t"))).withColumn("_l", lines)
    # every repeated expression gets a column of its own, so that no lambda computes it again for each element
    windows = F.transform(F.col("_w"), lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))
    d = d.withColumn("_h", F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(0))))
    d = d.select(
        "doc_id", *keep, "_h", F.sort_array("_h").alias("_s"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        dropped(SYMBOLS).cast("long").alias("n_symbols"),
        dropped("[!]").cast("long").alias("n_marks"),
        stop.cast("long").alias("n_stop_words"),
        F.array_size("_l").cast("long").alias("n_lines"),
        (F.array_size("_l") - F.array_size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, j: x == F.get(F.col("_s"), j + 1))))
    many = F.array_size("_d") > LOOKUP
    pairs = F.when(many, F.sort_array(F.transform(F.col("_h"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumn("_p", pairs)
    same = lambda x, j: F.coalesce(x["x"] == F.get(F.col("_p"), j)["x"], F.lit(False))
    sorted_starts = F.sort_array(F.transform(F.filter("_p", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    at = F.transform(F.col("_h"), lambda x, i: F.when(F.array_contains(F.col("_d"), x), i))
    starts = F.when(many, sorted_starts).when(F.array_size("_d") > 0, F.array_compact(at)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_r", starts)
    # a window covers three words; of two that overlap, the first counts only up to the second
    covered = F.transform(F.col("_r"), lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_r"), j + 1) - p, F.lit(3))).cast("long"))
    d = d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    # a number by row holds filters above the projections: pushed through, they would repeat the nested expressions without end
    return d.withColumn("_n", F.monotonically_increasing_id()).where("_n >= 0").drop("_n", "_h", "_s", "_d", "_p", "_r")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failing(rule: Rule) -> Column:
    value, base = 1000 * F.col(rule.metric), F.col(rule.base)
    bounds = [value < b * base for b in [rule.low] if b is not None] + [value > b * base for b in [rule.high] if b is not None]
    return reduce(lambda a, b: a | b, bounds, F.lit(False))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, failed_rules (names, comma-joined, in the table's order) and kept."""
    failed = F.concat_ws(",", *(F.when(failing(r), F.lit(r.name)) for r in rules))
    return measured.select("*", base_failed().alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == "")
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, that pass."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"))
    return judge(measure(packed, keep=("_row",)), rules).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(measure(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def _sql_rule(r: Rule) -> str:
    low = f"1000 * {r.metric} < {r.low} * {r.base}" if r.low is not None else "false"
    high = f"1000 * {r.metric} > {r.high} * {r.base}" if r.high is not None else "false"
    return f"CASE WHEN {low} OR {high} THEN '{r.name}' END"


def judged_sql(source: str, rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for judge(measure(source)); the columns of source follow."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
    WITH t AS (SELECT *, coalesce(text, '') AS tx FROM {source}),
    w AS (SELECT *, regexp_extract_all(tx, '[^\\x20\\x09-\\x0D]+') AS ws,
                 list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
    g AS (SELECT *, CASE WHEN len(ws) < 3 THEN [] ELSE list_transform(range(1, len(ws) - 1), lambda i: {{'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]}}) END AS tri FROM w),
    h AS (SELECT *,
                 list_sort(list_transform(range(1, len(tri) + 1), lambda i: {{'x': tri[i], 'i': i}})) AS st FROM g),
    r AS (SELECT *, list_transform(list_filter(range(1, len(st) + 1), lambda j: coalesce(st[j].x = st[j + 1].x, false) OR (j > 1 AND coalesce(st[j].x = st[j - 1].x, false))), lambda j: st[j].i) AS hit FROM h),
    m AS (SELECT *, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 (length(tx) - length(regexp_replace(tx, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (length(tx) - length(replace(tx, '!', '')))::BIGINT AS n_marks,
                 len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
                 len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 len(list_distinct(flatten(list_transform(hit, lambda i: [i, i + 1, i + 2]))))::BIGINT AS n_repeat_words FROM r),
    j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                 concat_ws(',', {', '.join(map(_sql_rule, rules))}) AS failed_rules FROM m)
    SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM j"""


ORACLE_SQL = (
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules "
    f"FROM ({judged_sql('documents')})"
)
