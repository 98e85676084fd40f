"""Sharding by balanced label propagation.

Documents of equal text are linked. Each starts in a shard that its number in the table's scratch copy decides; in
every round a link's plurality shard becomes its target, and its other members ask to move there. What may move is
settled by flows between shards: whatever fits in the room, and beyond it as much as leaves in the same round, in swaps and
longer cycles; where nobody asks to leave, small links that lie whole in the target make way together. Each move joins
more pairs than it parts, and rounds go on until none is possible. A shard that nobody can enter is passed over for the
next best one. Quotas cover linked documents only, as the others can fill any gap. At last each shard is brought to its
exact number of rows: linked documents over it leave, and they and the unlinked ones fill what is open.

Law `rows`: sizes in rows are at most one apart. Results in edge cases: null texts are linked with nothing and have
size 1; rows that repeat a doc_id, or have none, are placed each on its own; an empty table gives no rows; a group
larger than a shard fills it and goes on in the next. Columns other than those named are ignored by `place`; their names
may clash with nothing, as the operator works on its own copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, table

#: A hot link's members are dealt over so many partitions wherever they are joined.
SALTS = 16
#: Rows of a bucket in which ranks are counted.
BUCKET_ROWS = 20_000
#: Links of at most so many members may make way as a whole.
SMALL = 64


def _uniform(*of) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _ranked(df: DataFrame, by: str | None, rows: int) -> DataFrame:
    """Adds `rank`: gapless from 0 in each value of `by`. Rows are ranked in buckets, whose offsets are added."""
    keys = [by] if by else []
    d = df.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(max(64, rows // BUCKET_ROWS))))
    own = Window.partitionBy(*keys, "_b")
    sizes = d.groupBy(*keys, "_b").count()
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    d = d.withColumn("_r", F.row_number().over(own.orderBy("rid")))
    return d.join(maybe_broadcast(offsets), [*keys, "_b"]).withColumn("rank", F.col("_o") + F.col("_r") - 1).drop("_b", "_o", "_r")


def _by_shard(df: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}  # one row a shard
    return [found.get(j, 0) for j in range(shards)]


def _pick(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (shard + 1).cast("int"))


def _path(left: list[list[int]], starts: list[int], goals: set[int]) -> list[int] | None:
    """The shortest path of at least one step along positive entries."""
    seen, queue = set(), [[j] for j in starts]
    for path in queue:
        for t, n in enumerate(left[path[-1]]):
            if n > 0 and t in goals:
                return [*path, t]
            if n > 0 and t not in seen:
                seen.add(t)
                queue.append([*path, t])
    return None


def flows(demand: dict[tuple[int, int], int], room: list[int], spare: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """How many members go from shard to shard, and how many rows of whole links make way; room is negative where a shard is
    over its size. No shard takes in more than its room and what leaves it."""
    all_shards, room, spare = range(len(room)), list(room), list(spare)
    left = [[demand.get((s, t), 0) for t in all_shards] for s in all_shards]
    flow = [[0 for _ in all_shards] for _ in all_shards]
    way = [[0 for _ in all_shards] for _ in all_shards]

    def push(path: list[int], most: int | None) -> None:
        steps = list(zip(path, path[1:], strict=False))
        n = min(left[s][t] for s, t in steps)
        n = n if most is None else min(n, most)
        for s, t in steps:
            left[s][t] -= n
            flow[s][t] += n
        room[path[0]] += n
        room[path[-1]] -= n

    while path := _path(left, [j for j in all_shards if room[j] < 0], {j for j in all_shards if room[j] > 0}):
        push(path, min(-room[path[0]], room[path[-1]]))
    for j in all_shards:
        while path := _path(left, [j], {j}):
            push(path, None)
    # no cycles are left, so room handed from shard to shard runs out
    while path := _path(left, list(all_shards), {j for j in all_shards if room[j] > 0}):
        push(path[-2:], room[path[-1]])
    for s in all_shards:
        for t in all_shards:
            n = min(left[s][t], spare[t])
            flow[s][t] += n
            way[t][s] += n
            spare[t] -= n
    for s in all_shards:
        for t in all_shards:
            n = max(0, min(-room[s], room[t], spare[s]))
            way[s][t] += n
            spare[s] -= n
            room[s] += n
            room[t] -= n
    return flow, way


def propagate(linked: DataFrame, target: list[int], scratch: Scratch) -> DataFrame:
    """linked: rid, key, shard; target: the rows of each shard. Returns linked with the shards when no link can improve."""
    shards, rows = len(target), sum(target)
    closed, moved, least_over, i, spread, names = set(), False, rows + 1, 0, None, []
    while True:
        if spread is None:
            parts = F.collect_list(F.struct("count", "shard")).alias("parts")  # at most one a shard
            spread = scratch.save(linked.groupBy("key", "shard").count().groupBy("key").agg(parts), f"spread{i}", rows)
            found = {r["shard"]: r["n"] for r in spread.select(F.inline("parts")).groupBy("shard").agg(F.sum("count").alias("n")).collect()}
            room = [n - found.get(j, 0) for j, n in enumerate(target)]
            names.append(f"spread{i}")
        is_open = lambda p: _pick([j not in closed for j in range(shards)], p["shard"])  # noqa: B023, E731
        ranks = F.transform(F.filter("parts", is_open), lambda p: F.struct(p["count"].alias("count"), F.xxhash64("key", p["shard"], F.lit(i)).alias("tie"), p["shard"].alias("shard")))  # noqa: B023
        best = spread.withColumn("best", F.array_max(ranks))
        # members leave a shard only for one that holds at least as many
        asks = F.filter("parts", lambda p: (p["shard"] != F.col("best.shard")) & (p["count"] <= F.col("best.count")))
        whole = F.filter("parts", lambda p: (F.array_size("parts") == 1) & (p["count"] <= SMALL))
        moves = best.select("key", "best.shard", F.when(F.array_size("parts") > 1, asks).otherwise(whole).alias("from"), (F.array_size("parts") == 1).alias("whole"))
        moves = moves.select("key", F.when(~F.col("whole"), F.col("shard")).alias("target"), F.inline("from"))
        asked = {(r["shard"], r["target"]): r["n"] for r in moves.groupBy("shard", "target").agg(F.sum("count").alias("n")).collect()}  # at most shards squared
        spare = [asked.pop((j, None), 0) for j in range(shards)]
        flow, way = flows(asked, room, spare)
        over = sum(max(0, -r) for r in room)
        if not any(map(any, flow)):
            if any(map(any, way)) and over < least_over:
                least_over = over
            elif asked:
                closed |= {t for _, t in asked}
                i += 1
                continue
            elif closed and moved:
                closed, moved = set(), False
                i += 1
                continue
            else:
                return linked
        else:
            moved = True
        # pairs of shards by number: quotas of members by rank, those of whole links by the hash of the link
        quota = [n for row in flow for n in row]
        part = [0 < flow[s][t] < asked.get((s, t), 0) for s in range(shards) for t in range(shards)]
        steps = [[sum(row[: t + 1]) / max(1, spare[s]) for t in range(shards)] for s, row in enumerate(way)]
        u = _uniform("key", F.lit(i), F.lit("way"))
        to = F.array_size(F.filter(_pick([F.array(*map(F.lit, x)) for x in steps], F.col("shard")), lambda x: x <= u)).cast("int")  # noqa: B023
        to = F.when(to < shards, to)
        pair = F.col("shard") * shards + F.col("target")
        moves = moves.select("key", "shard", F.coalesce("target", to).alias("target"), F.col("target").isNull().alias("whole"))
        moves = moves.where(F.col("target").isNotNull() & (F.col("whole") | (_pick(quota, pair) > 0)))
        moves = moves.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = linked.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
        dealt = dealt.join(maybe_broadcast(moves), ["key", "shard", "salt"], "left")
        dealt = scratch.save(dealt.select("rid", "key", "shard", "target", F.when(_pick(part, pair) & ~F.col("whole"), pair).alias("pair")), f"dealt{i}", rows)
        new = F.coalesce("target", "shard").alias("shard")
        ranked = _ranked(dealt.where("pair IS NOT NULL"), "pair", rows)
        some = ranked.select("rid", "key", F.when(F.col("rank") < _pick(quota, F.col("pair")), F.col("target")).otherwise(F.col("shard")).alias("shard"))
        linked = scratch.save(dealt.where("pair IS NULL").select("rid", "key", new).unionByName(some), f"linked{i}", rows)
        for name in (f"dealt{i}", *names):
            scratch.drop(name)
        names, spread, i = [f"linked{i}"], None, i + 1


def place(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs: doc_id, text. One row per row: doc_id, size, text_crc32, rid, shard, slot, start_shard, and link (null if alone)."""
    scratch = Scratch(docs.sparkSession, "sharding")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = scratch.save(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.unhex(F.sha2(raw, 256))).alias("key"),
        ),
        "rows",
    )
    n = rows.count()
    target = [n // shards + (j < n % shards) for j in range(shards)]
    groups = rows.where("key IS NOT NULL").groupBy("key").count().where("count > 1").select("key")
    salted = groups.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    flagged = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    flagged = flagged.join(maybe_broadcast(salted).withColumn("_in", F.lit(True)), ["key", "salt"], "left")
    start = F.pmod(F.xxhash64("rid", F.lit("start")), F.lit(shards)).cast("int")
    rows = scratch.save(
        flagged.select("rid", "doc_id", "size", "text_crc32", F.when(F.col("_in"), F.col("key")).alias("key"), start.alias("start_shard")), "flagged"
    )
    scratch.drop("rows")
    linked = rows.where("key IS NOT NULL").select("rid", "key", F.col("start_shard").alias("shard"))
    linked = propagate(linked, target, scratch)
    ranked = scratch.save(_ranked(linked.select("rid", "shard"), "shard", n), "ranked", n)
    scratch.keep("flagged", "ranked")
    kept = [min(a, b) for a, b in zip(_by_shard(ranked, shards), target, strict=True)]
    stays = F.col("rank") < _pick(target, F.col("shard"))
    settled = ranked.where(stays).select("rid", "shard", F.col("rank").alias("slot"))
    pool = rows.where("key IS NULL").select("rid").unionByName(ranked.where(~stays).select("rid"))
    ends, total = [], 0
    for a, b in zip(target, kept, strict=True):
        total += a - b
        ends.append(total)
    starts = [e - (a - b) for e, a, b in zip(ends, target, kept, strict=True)]
    shard = F.array_size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("rank"))).cast("int")
    filled = _ranked(pool, None, n).withColumn("shard", shard)
    filled = filled.select("rid", "shard", (F.col("rank") - _pick(starts, F.col("shard")) + _pick(kept, F.col("shard"))).alias("slot"))
    placed = settled.unionByName(filled)
    return rows.join(placed, "rid").select(
        "doc_id", "size", "text_crc32", "rid", "shard", F.col("slot").cast("long").alias("slot"), "start_shard", F.col("key").alias("link")
    )


def cut_links(placed: DataFrame, shard: str = "shard") -> int:
    """Pairs of linked documents that lie in different shards."""
    n = placed.where("link IS NOT NULL").groupBy("link", shard).agg(F.count("*").cast("decimal(38,0)").alias("n"))
    cut = n.groupBy("link").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("c"))
    return int(cut.agg(F.coalesce(F.sum("c"), F.lit(0)) / 2).first()[0])


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(place(table(spark, sf_dir, "documents").select("doc_id", "text")))
