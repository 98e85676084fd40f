"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic. Cell weights are raked: one margin after the other is scaled to
its targets, again and again, until no margin is further than TOLERANCE from its target, or for ROUNDS at most: targets
that empty cells make impossible are never met. `margin_error` tells the largest gap that is left. A cell's factor is its raked share over its
own share; divided by the largest factor it is the probability with which each of its documents is drawn, so that no document is
needed twice and expected margins are the targets.

Targets are shares by value (`fixed`), or `tempered`: a value's tokens to a power, normalised. The table has no topics;
`length_topic` stands in: brief, article or long.

Results in edge cases: a null source, language or topic is a value of its own; null or empty texts have no tokens and the
probability of their cell, and where a whole cell or margin has none, 0; an empty table gives no rows. Rows of one doc_id
are drawn together; without a doc_id the text decides. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, looked_up, small, table, white_words

DIMS = ("source", "lang", "topic")
#: Powers to which a value's tokens are raised for its target.
TEMPER = {"source": 0.9, "lang": 0.95, "topic": 0.95}
#: The largest gap between a margin's share and its target that ends the raking, the most rounds, and rounds between two looks at the gap.
TOLERANCE, ROUNDS, LOOK = 1e-6, 40, 4
#: Up to this many cells, all rounds run in one task; beyond, each margin is dealt by its value.
ONE_TASK_CELLS = 15_000
SEED = 7


def length_topic(words: Column) -> Column:
    return F.when(words < 100, F.lit("brief")).when(words < 1000, F.lit("article")).otherwise(F.lit("long"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """value, share: the targets of one margin."""
    d = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens"))
    d = d.select("value", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(power))).otherwise(F.lit(0.0)).alias("x"))
    total = d.agg(F.sum("x")).first()[0]
    return d.select("value", (F.col("x") / F.lit(total)).alias("share") if total else F.lit(0.0).alias("share"))


def margin_error(raked: DataFrame, dims: tuple[str, ...]) -> float:
    """The largest gap between a value's share of the weight and its target; 0 without weight."""
    total = raked.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    gap = lambda dim: raked.groupBy(dim).agg(F.abs(F.sum("weight") / F.lit(total) - F.max(f"_t_{dim}")).alias("gap")).agg(F.max("gap"))
    return max(gap(dim).first()[0] for dim in dims)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """cells: the dims and tokens; targets: value, share by dim. Adds weight: the raked share, 0 without tokens; and margin_error, one number."""
    scratch = scratch or Scratch(cells.sparkSession, "raking")
    d = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim, t in targets.items():
        t = t.select(F.col("value").alias("_v"), F.col("share").alias(f"_t_{dim}"))
        d = d.join(t, d[dim].eqNullSafe(t["_v"]), "left").drop("_v").fillna(0.0, [f"_t_{dim}"])
    d = scratch.save(d, "cells")
    one, error, i = small(d, ONE_TASK_CELLS), 0.0, 0
    while i < rounds:
        d = d.coalesce(1).sortWithinPartitions(*targets) if one else d
        for _ in range(min(LOOK if one else 1, rounds - i)):
            for dim in targets:
                margin = F.sum("weight").over(Window.partitionBy(dim))
                d = d.withColumn("weight", F.when(margin > 0, F.col("weight") * F.col(f"_t_{dim}") / margin).otherwise(F.lit(0.0)))
            i += 1
        d = scratch.save(d, f"round{i}")
        if i % LOOK == 0 or i == rounds:
            error = margin_error(d, tuple(targets))
            if error <= TOLERANCE:
                break
    return d.select(*cells.columns, "weight", F.lit(error).alias("margin_error"))


def calibrated(raked: DataFrame) -> DataFrame:
    """Adds probability: the cell's factor over the largest one."""
    tokens, weight = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    if not tokens or not weight:
        return raked.withColumn("probability", F.lit(0.0))
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.lit(weight) / (F.col("tokens") / F.lit(tokens))).otherwise(F.lit(0.0))
    most = raked.agg(F.max(factor)).first()[0]
    return raked.withColumn("probability", F.round(factor / F.lit(most), 9))


def mix(docs: DataFrame, temper: dict[str, float] | None = None, rounds: int = ROUNDS, keep: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """docs: doc_id, text, source, lang and the columns of keep. One row per row: keep, the dims as _mix_source,
    _mix_lang, _mix_topic, n_tokens, probability, sampled, _mix_error."""
    temper = TEMPER if temper is None else temper
    scratch = Scratch(docs.sparkSession, "mixing")
    # a number of 52 bits from 0 up to 1
    drawn = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))), F.lit(f"#{seed}")), "UTF-8"))
    u = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    d = docs.select(
        F.struct(*(F.col(k) for k in keep)).alias("_keep"), F.col("source"), F.col("lang"), F.array_size(white_words(F.col("text"))).cast("long").alias("n_tokens"),
        u.alias("_u"),
    )
    d = d.withColumn("topic", length_topic(F.col("n_tokens")))
    cells = scratch.save(d.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "counted")
    cells = calibrated(rake(cells, {k: tempered(cells, k, p) for k, p in temper.items()}, rounds, scratch))
    cells = scratch.save(cells.select(*(F.col(k).alias(f"_{k}") for k in DIMS), "probability", "margin_error"), "calibrated")
    scratch.keep("calibrated")
    # keys without nulls, so that a hot cell's rows can be dealt where cells are too many to broadcast
    keys = [f"_{x}_{k}" for k in DIMS for x in ("is", "of")]
    keyed = lambda df, name: df.withColumns({f"_is_{k}": F.col(name(k)).isNull() for k in DIMS} | {f"_of_{k}": F.coalesce(name(k), F.lit("")) for k in DIMS})
    found = looked_up(keyed(d, lambda k: k), keyed(cells, lambda k: f"_{k}").drop(*(f"_{k}" for k in DIMS)), keys, "_u")
    return found.select(
        "_keep.*", *(F.col(k).alias(f"_mix_{k}") for k in DIMS), "n_tokens", "probability", (F.col("_u") < F.col("probability")).alias("sampled"), F.col("margin_error").alias("_mix_error")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(table(spark, sf_dir, "documents"))
    d = d.withColumn("margins_met", F.col("_mix_error") <= TOLERANCE).drop("_mix_error")
    return d.withColumnsRenamed({f"_mix_{k}": k for k in DIMS})


def _raking_sql() -> str:
    """A step for each margin of each round; after each LOOK rounds nothing changes any more if the margins are met."""
    steps, now = [], "r0"
    for i in range(1, ROUNDS + 1):
        for k in DIMS:
            margin = f"sum(w) OVER (PARTITION BY {k})"
            new = f"CASE WHEN met THEN w WHEN {margin} > 0 THEN w * t_{k} / {margin} ELSE 0 END"
            steps.append(f"r{i}_{k} AS MATERIALIZED (SELECT * REPLACE ({new} AS w) FROM {now})")
            now = f"r{i}_{k}"
        if i % LOOK == 0 or i == ROUNDS:
            gaps = ", ".join(f"abs(sum(w) OVER (PARTITION BY {k}) / sum(w) OVER () - t_{k})" for k in DIMS)
            steps.append(f"m{i} AS MATERIALIZED (SELECT * REPLACE (met OR coalesce((SELECT max(g) FROM (SELECT greatest({gaps}) AS g FROM {now})) <= {TOLERANCE}, true) AS met) FROM {now})")
            now = f"m{i}"
    return ", ".join(steps) + f", raked AS MATERIALIZED (SELECT * FROM {now})"


def _oracle_sql() -> str:
    cells = ", ".join(DIMS)
    targets = ", ".join(
        f"v_{k} AS (SELECT {k}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {p}) ELSE 0 END AS x FROM cells GROUP BY {k}), "
        f"t_{k} AS MATERIALIZED (SELECT {k}, x / (SELECT sum(x) FROM v_{k}) AS t_{k} FROM v_{k})"
        for k, p in TEMPER.items()
    )
    joins = " ".join(f"JOIN t_{k} ON c.{k} IS NOT DISTINCT FROM t_{k}.{k}" for k in DIMS)
    shares = ", ".join(f"t_{k}.t_{k} AS t_{k}" for k in DIMS)
    key = "coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))"
    return f"""
    WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
        ('0x' || substr(md5({key} || '#{SEED}'), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u FROM documents),
    t AS MATERIALIZED (SELECT *, CASE WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM d),
    cells AS MATERIALIZED (SELECT {cells}, sum(n_tokens)::DOUBLE AS tokens FROM t GROUP BY {cells}),
    {targets},
    r0 AS MATERIALIZED (SELECT c.*, {shares}, c.tokens AS w, false AS met FROM cells c {joins}),
    {_raking_sql()},
    f AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN w / (SELECT sum(w) FROM raked) / (tokens / (SELECT sum(tokens) FROM raked)) ELSE 0 END AS factor FROM raked),
    p AS MATERIALIZED (SELECT *, round(factor / (SELECT max(factor) FROM f), 9) AS probability FROM f)
    SELECT t.doc_id, t.source, t.lang, t.topic, n_tokens, probability, u < probability AS sampled, met AS margins_met
    FROM t JOIN p ON {" AND ".join(f"t.{k} IS NOT DISTINCT FROM p.{k}" for k in DIMS)}"""


ORACLE_SQL = _oracle_sql()
