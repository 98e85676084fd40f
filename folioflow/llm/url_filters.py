"""URL filters: rules, and for what no rule fits a ratio of character language models.

Two variable-order Markov models, of URLs that rules allow and of those they block, give each character a probability
after up to ORDER characters before it: counts of the longest context are smoothed towards those of the next shorter
one, and at last towards equal chances. A URL's score is the difference of the log-likelihoods divided by its length;
the threshold is the one that separates held-out ruled URLs best. Whole URLs are modelled, with scheme, query and fragment.

A model row holds what its context adds to the log-ratio over the next shorter context, in whole millionths: by the character
that follows, or, for one that never followed it in either kind, by the weight that is left to the shorter context. A context
that was not seen adds nothing, so the sum of what is found is the difference of the smoothed models' log-likelihoods.

Results in edge cases: a URL without :// has an empty host and path and no rule, and is scored like any other; a null URL is
scored as an empty one, 0; with no ruled URLs of a kind the other models stand against equal chances; without any, the
threshold is 0 and all are allowed. Rows that repeat a page_id, or have none, are judged each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, looked_up, table

#: Characters of context.
ORDER = 4
#: Weight of the shorter context, in occurrences, and the chances at the start.
WEIGHT, ALPHABET = 4.0, 128.0
#: Of ruled URLs, one in so many is held out to place the threshold; the steps of the threshold in millionths.
HELD_OUT, STEP = 5, 20_000
#: Scores are clipped to this many steps when they are counted for the threshold.
STEPS = 500
#: URLs of a task that scores them.
TASK_URLS = 20_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"^(?s)(?:.*?)://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of keep, host, path, rule and ruled (its verdict). The longest rule wins; of equal ones the first."""
    url = F.coalesce(F.col("_u"), F.lit(""))
    d = pages.select(*(F.col(k) for k in keep), F.col("url").alias("_u"))
    d = d.select(*keep, F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))
    host, path = F.col("host"), F.col("path")
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    first = lambda of: reduce(lambda a, r: a.when(fits(r), F.lit(of(r))), sorted(rules, key=lambda r: -len(r.text)), F.when(F.lit(False), None))
    return d.withColumn("rule", first(lambda r: r.text)).withColumn("ruled", first(lambda r: r.verdict))


def grams(df: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of `s` and each context of 0 to `order` characters; the start is marked by \\u0001. No row carries the text."""
    d = df.where("s != ''").select(*keep, F.split(F.concat(F.lit("\x01"), F.col("s")), "").alias("_c"))
    # element i of the tail stands at i + 2 of the text, counted from 1
    last = F.transform(F.slice("_c", 2, F.array_size("_c")), lambda _, i: F.array_join(F.slice(F.col("_c"), F.greatest(i + 2 - order, F.lit(1)), F.least(i + 2, F.lit(order + 1))), ""))
    d = d.select(*keep, F.explode(last).alias("_l"))
    return d.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("_l")), lambda k: F.right(F.col("_l"), k))).alias("gram"))


def train(labelled: DataFrame, scratch: Scratch, order: int = ORDER) -> Model:
    """labelled: s, good. The deltas: millionths that a gram adds to the log-ratio of its ending."""
    seen = grams(labelled, order, "good").groupBy("gram").agg(
        F.count_if(F.col("good")).alias("a"), F.count_if(~F.col("good")).alias("b")
    )
    seen = scratch.save(seen.withColumn("k", F.length("gram") - 1).withColumn("context", F.expr("left(gram, k)")), "grams")
    totals = scratch.save(seen.groupBy("context", "k").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")), "totals")
    seen = scratch.save(seen.join(totals, ["context", "k"]).drop("context"), "counts")
    chance = lambda n, t, p: (F.col(n) + WEIGHT * F.col(p)) / (F.col(t) + WEIGHT)
    flat = F.lit(1.0 / ALPHABET)
    model, last = None, None
    ratio = lambda x, y: F.round((F.log(x) - F.log(y)) * 1e6).cast("long")
    for k in range(order + 1):
        d = seen.where(F.col("k") == k)
        if last is None:
            d = d.withColumns({"qa": flat, "qb": flat})
        else:
            shorter = last.select(F.col("gram").alias("ending"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            d = d.withColumn("ending", F.expr("substring(gram, 2)")).join(shorter, "ending")
        d = d.withColumns({"pa": chance("a", "ta", "qa"), "pb": chance("b", "tb", "qb")})
        last = scratch.save(d.select("gram", "pa", "pb", "qa", "qb"), f"order{k}")
        part = last.select("gram", (ratio(F.col("pa"), F.col("pb")) - ratio(F.col("qa"), F.col("qb"))).alias("delta"))
        model = part if model is None else model.unionByName(part)
    # the weight that a context leaves to what never followed it
    rest = totals.select(F.col("context").alias("gram"), ratio(F.col("tb") + WEIGHT, F.col("ta") + WEIGHT).alias("rest"))
    return Model(scratch.save(model, "model"), scratch.save(rest, "rest"))


@dataclass(frozen=True)
class Model:
    """deltas: gram, delta by seen gram; rests: gram, rest by seen context."""

    deltas: DataFrame
    rests: DataFrame


def scored(urls: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """urls: s, distinct. Adds score: millionths of the log-likelihood difference a character; 0 for an empty text."""
    session = urls.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, urls.count() // TASK_URLS)
    # a number stands for the text wherever its grams go; they are many, so few texts make a task
    urls = Scratch(session, "scores").save(urls.repartition(tasks, "s").withColumn("_u", F.monotonically_increasing_id()), "urls")
    parts = grams(urls.select("s", "_u"), order, "_u")
    parts = looked_up(parts, model.deltas, ["gram"], "_u", how="left")
    context = F.when(F.col("delta").isNull(), F.expr("left(gram, length(gram) - 1)"))
    parts = parts.select("_u", "delta", context.alias("gram"))
    parts = looked_up(parts, model.rests, ["gram"], "_u", how="left").where("delta IS NOT NULL OR rest IS NOT NULL")
    sums = parts.groupBy("_u").agg(F.sum(F.coalesce("delta", "rest")).alias("sum"))
    score = F.coalesce(F.expr("sum div greatest(length(s), 1)"), F.lit(0).cast("long"))
    return urls.join(sums, "_u", "left").select(*(c for c in urls.columns if c != "_u"), score.alias("score"))


def threshold(held: DataFrame, model: Model, order: int = ORDER) -> int:
    """held: s, good. The threshold for their scores."""
    return best_cut(scored(held, model, order))


def best_cut(scores: DataFrame) -> int:
    """scores: score, good. The step that keeps the largest sum of both kinds' right shares; of equal ones the middle."""
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.expr(f"cast(floor(score / {STEP}) as int)")))
    rows = scores.groupBy(step.alias("step")).agg(F.count_if(F.col("good")).alias("a"), F.count_if(~F.col("good")).alias("b"))
    rows = sorted((r["step"], r["a"], r["b"]) for r in rows.collect())  # at most 2 * STEPS + 1 rows
    a, b = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not a or not b:
        return 0
    right = []
    for t in range(-STEPS, STEPS + 2):
        share = sum(n for s, n, _ in rows if s >= t) / a + sum(n for s, _, n in rows if s < t) / b
        right.append((share, t))
    most = max(x for x, _ in right)
    best = [t for x, t in right if x == most]
    return best[len(best) // 2] * STEP


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score (millionths of log-ratio a character, less the threshold)."""
    scratch = Scratch(pages.sparkSession, "urls")
    d = parsed(pages.select("page_id", "url", F.coalesce("url", F.lit("")).alias("s")), rules, keep=("page_id", "s"))
    d = scratch.save(d.withColumn("row", F.monotonically_increasing_id()), "parsed")
    urls = scratch.save(d.groupBy("s").agg(F.max("ruled").alias("ruled")), "urls")  # the URL decides the rule
    known = urls.where("ruled IS NOT NULL").select("s", (F.col("ruled") == "allow").alias("good"))
    held = F.conv(F.substring(F.md5(F.encode("s", "UTF-8")), 1, 8), 16, 10).cast("long") % HELD_OUT == 0
    model = train(known.where(~held), scratch, order)
    scores = scratch.save(scored(urls, model, order), "scored")  # held-out ones among them, so that all are scored once
    at = best_cut(scores.where(F.col("ruled").isNotNull() & held).select("score", (F.col("ruled") == "allow").alias("good")))
    scratch.keep("parsed", "scored")
    # a URL may stand in a third of all rows
    d = looked_up(d, scores.select("s", (F.col("score") - at).alias("score")), ["s"], "row")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0, F.lit("allow")).otherwise(F.lit("block")))
    return d.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def _case_sql(of, rules: tuple[UrlRule, ...]) -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{of(r)}'" for r in sorted(rules, key=lambda r: -len(r.text))) + " END"


def _grams_sql(source: str, *keep: str) -> str:
    columns = ", ".join(keep)
    at = f"SELECT {columns}, chr(1) || s AS t, unnest(range(2, length(s) + 2)) AS i FROM {source} WHERE s <> ''"
    return f"SELECT {columns}, substr(t, i - k, k + 1) AS gram FROM (SELECT *, unnest(range(0, least({ORDER}, i - 1) + 1)) AS k FROM ({at}))"


def _oracle_sql(rules: tuple[UrlRule, ...] = RULES) -> str:
    ratio = lambda x, y: f"round((ln({x}) - ln({y})) * 1e6)::BIGINT"
    chance = lambda n, t, q: f"({n} + {WEIGHT} * {q}) / ({t} + {WEIGHT})"
    orders = []
    for k in range(ORDER + 1):
        q = f"o{k - 1}.pa AS qa, o{k - 1}.pb AS qb FROM seen JOIN o{k - 1} ON substr(seen.gram, 2) = o{k - 1}.gram" if k else f"1.0::DOUBLE / {ALPHABET} AS qa, 1.0::DOUBLE / {ALPHABET} AS qb FROM seen"
        orders.append(
            f"o{k} AS MATERIALIZED (SELECT gram, qa, qb, {chance('a', 'ta', 'qa')} AS pa, {chance('b', 'tb', 'qb')} AS pb FROM (SELECT seen.*, {q} WHERE seen.k = {k}) JOIN totals USING (context, k))"
        )
    deltas = " UNION ALL ".join(f"SELECT gram, {ratio('pa', 'pb')} - {ratio('qa', 'qb')} AS delta FROM o{k}" for k in range(ORDER + 1))
    return f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS s FROM pages),
    h AS (SELECT *, translate(regexp_extract(s, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(s, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
    parsed AS MATERIALIZED (SELECT *, {_case_sql(lambda r: r.text, rules)} AS rule, {_case_sql(lambda r: r.verdict, rules)} AS ruled FROM h),
    urls AS MATERIALIZED (SELECT s, max(ruled) AS ruled FROM parsed GROUP BY s),
    known AS MATERIALIZED (SELECT s, ruled = 'allow' AS good, ('0x' || substr(md5(s), 1, 8))::BIGINT % {HELD_OUT} = 0 AS held FROM urls WHERE ruled IS NOT NULL),
    train AS (SELECT s, good FROM known WHERE NOT held),
    counted AS (SELECT gram, count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS b FROM ({_grams_sql('train', 'good')}) GROUP BY gram),
    seen AS MATERIALIZED (SELECT *, length(gram) - 1 AS k, left(gram, length(gram) - 1) AS context FROM counted),
    totals AS MATERIALIZED (SELECT context, k, sum(a) AS ta, sum(b) AS tb FROM seen GROUP BY context, k),
    {", ".join(orders)},
    deltas AS MATERIALIZED ({deltas}),
    rests AS MATERIALIZED (SELECT context AS gram, {ratio(f'(tb + {WEIGHT})', f'(ta + {WEIGHT})')} AS rest FROM totals),
    parts AS (SELECT s, gram FROM ({_grams_sql('urls', 's')})),
    sums AS (SELECT s, sum(coalesce(delta, rest)) AS total FROM parts LEFT JOIN deltas USING (gram) LEFT JOIN rests ON rests.gram = left(parts.gram, length(parts.gram) - 1) GROUP BY s),
    scored AS MATERIALIZED (SELECT s, coalesce(sign(total) * (abs(total)::BIGINT // greatest(length(s), 1)), 0)::BIGINT AS score FROM urls LEFT JOIN sums USING (s)),
    held AS (SELECT greatest(-{STEPS}, least({STEPS}, floor(score / {STEP}.0::DOUBLE)::INT)) AS step, good FROM known JOIN scored USING (s) WHERE held),
    steps AS MATERIALIZED (SELECT step, count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS b FROM held GROUP BY step),
    whole AS (SELECT sum(a) AS a, sum(b) AS b FROM steps),
    shares AS MATERIALIZED (SELECT t, coalesce((SELECT sum(a) FROM steps WHERE step >= t), 0)::DOUBLE / whole.a::DOUBLE + coalesce((SELECT sum(b) FROM steps WHERE step < t), 0)::DOUBLE / whole.b::DOUBLE AS share
        FROM range(-{STEPS}, {STEPS} + 2) AS r(t), whole WHERE whole.a > 0 AND whole.b > 0),
    best AS (SELECT list(t ORDER BY t) AS ts FROM shares WHERE share = (SELECT max(share) FROM shares)),
    threshold AS (SELECT coalesce(ts[len(ts) // 2 + 1] * {STEP}, 0) AS cut FROM best)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score - cut >= 0 THEN 'allow' ELSE 'block' END) AS verdict, (score - cut)::BIGINT AS score
    FROM parsed JOIN scored USING (s), threshold"""


ORACLE_SQL = _oracle_sql()
