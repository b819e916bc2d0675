"""Mixing sources to target weights by Poisson replication.

Each document gets a number of copies: the inverse Poisson distribution at a
uniform value hashed from seed, doc_id and text, whose mean is its source's repetition rate
(target characters over characters it has). Documents are exploded by that number and
shuffled globally by a hash of seed, doc_id and copy. Only SQL functions are used.

A source's distribution is tabled once, for the counts within twelve deviations and thirty of its rate (what lies beyond
has less than 1e-30): 24 roots of the rate and some 60 numbers. Its terms are prefix sums, and each document
finds its count by bisection.

A null source is a source of its own. Empty sources (no characters) have rate one.
Repeated rows get equal counts. An empty table gives no rows. All columns of the input stay; columns named like the results are
replaced. The tables of all sources are broadcast only if they hold at most BROADCAST_TERMS numbers in all; otherwise only those of hot
sources are, and the others are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import split_join, table, written

BROADCAST_TERMS = 1 << 20
#: Share of a source is its characters to this power, for want of explicit weights.
TEMPERATURE = 0.5
SEED = 17
UNIT = 2.0**-52
RESULTS = ["copies", "copy", "shuffle_key"]


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from 52 bits of an MD5 hash."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10)
    return (h.cast("long").cast("double") + 0.5) * UNIT


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): rows and mean number of copies of each source."""
    have = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("have"))
    have = written(have, "sources")
    if weights is None:
        share = F.pow(F.col("have").cast("double"), F.lit(TEMPERATURE))
    else:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.0))
    have = have.withColumn("share", share)
    total = have.agg(F.sum("have").alias("all_have"), F.sum("share").alias("all_share"))
    rate = F.when(F.col("have") == 0, 1.0).otherwise(
        F.lit(epochs) * F.col("share") / F.col("all_share") * F.col("all_have") / F.col("have")
    )
    return have.crossJoin(F.broadcast(total)).select("source", "n", rate.alias("rate"))  # one row


def distributions(rate: DataFrame) -> DataFrame:
    """``rate`` (one row a source) with ``low`` and ``cdf``: cdf[k] = P(count <= low + k), by prefix sums."""
    spread = 12 * F.sqrt("rate") + 30
    rate = rate.withColumn("low", F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long"))
    k = F.explode(F.sequence(F.col("low"), F.floor(F.col("rate") + spread).cast("long"))).alias("k")
    some = rate.where("rate > 0")
    # Logarithms relative to the first term, then to the largest one: no term overflows, and the sum normalises them.
    own = Window.partitionBy("source").orderBy("k")
    up, whole = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("source")
    terms = some.select("source", "rate", "low", k).withColumn("log", F.sum(F.when(F.col("k") > F.col("low"), F.log(F.col("rate") / F.col("k"))).otherwise(0.0)).over(up))
    terms = terms.withColumn("p", F.exp(F.col("log") - F.max("log").over(whole)))
    terms = terms.select("source", "k", (F.sum("p").over(up) / F.sum("p").over(whole)).alias("c"))
    lists = terms.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda t: t["c"]).alias("cdf"))
    lists = lists.withColumnRenamed("source", "_own")
    return rate.join(lists, F.col("source").eqNullSafe(F.col("_own")), "left").drop("_own")


def _count(cdf: Column, low: Column, u: Column) -> Column:
    """Number of values below u in the ascending ``cdf``, by bisection, and ``low``; 0 without a table."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cdf).cast("double") + 1)).cast("int"))

    def half(a, _):
        middle = F.floor((a["at"] + a["end"]) / 2).cast("int")
        below = F.element_at(cdf, middle + 1) < u
        open_ = a["at"] < a["end"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(a["at"]).alias("at"), F.when(open_ & ~below, middle).otherwise(a["end"]).alias("end"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.size(cdf).alias("end")), half, lambda a: a["at"])
    return F.when(cdf.isNull(), F.lit(0)).otherwise(found + low).cast("int")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with ``copies``, ``copy`` (from 0) and ``shuffle_key``."""
    names = [c for c in docs.columns if c not in RESULTS]
    # A text, so that null sources join; no source's own name starts with either letter alone.
    name = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    r = written(distributions(rates(docs, weights, epochs)).select(name.alias("key"), "n", "low", "cdf"), "rates")
    have = r.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.size("cdf"))), F.lit(0)).alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    rows = docs.select(F.struct(*names).alias("row"), name.alias("key"), uniform(F.lit(seed), F.col("doc_id"), F.col("text")).alias("u"))
    out = rows.join(F.broadcast(r), "key") if have["terms"] <= BROADCAST_TERMS else split_join(rows, r, "key", "n", have["rows"])
    # Lambda variables bind the hash and the count, which would else be computed once per use.
    counts = F.transform(F.array("u"), lambda u: _count(F.col("cdf"), F.col("low"), u))
    repeats = F.flatten(F.transform(counts, lambda n: F.array_repeat(n, n)))
    # An inner generator would infer a filter that hashes every text once more.
    out = out.select("row", F.posexplode_outer(repeats).alias("copy", "copies")).where("copy is not null")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    return out.select("row.*", "copies", "copy", key.alias("shuffle_key"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The global order by ``shuffle_key``, in partitions that follow each other.

    Keys are hashes and thus spread evenly, so ranges need no sampling pass.
    """
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.shiftright(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n, 32).cast("int")
    return mixed.repartitionById(n, at).sortWithinPartitions("shuffle_key")


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = replicate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return shuffled(mixed.select("doc_id", "source", F.col("copies").cast("long").alias("copies"), F.col("copy").cast("long").alias("copy"), "shuffle_key"))


OP6_SQL = f"""
WITH RECURSIVE have AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS have FROM documents GROUP BY source),
share AS (SELECT source, have, pow(CAST(have AS DOUBLE), {TEMPERATURE}) AS share FROM have),
rate AS (SELECT source, CASE WHEN have = 0 THEN 1.0 ELSE
    CAST(share AS DOUBLE) / (SELECT sum(share) FROM share) * CAST((SELECT sum(have) FROM share) AS DOUBLE) / have END AS rate FROM share),
cdf(source, rate, k, lg, c) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, lg + ln(rate) - ln(k + 1), c + exp(lg + ln(rate) - ln(k + 1)) FROM cdf
  WHERE k < CAST(floor(rate + 12 * sqrt(rate) + 30) AS INT)),
d AS (SELECT doc_id, source, (CAST(CAST('0x' || left(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 13) AS BIGINT) AS DOUBLE) + 0.5) * {UNIT!r} AS u FROM documents),
n AS (SELECT d.doc_id, d.source, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c < d.u) AS copies FROM d)
SELECT doc_id, source, copies, copy, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT doc_id, source, copies, unnest(range(copies)) AS copy FROM n)
"""
