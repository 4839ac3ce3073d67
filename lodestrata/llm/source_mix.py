"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of all bytes over its present share. A document's number of
copies is drawn from the Poisson distribution of that mean by inversion: a uniform number from the seeded hash of its
doc_id is looked up in the source's cumulative distribution. Counts are thus repeatable, independent of partitions, and
right in mean for each source. Documents are exploded by their counts, and a global shuffle follows: copies go to
partitions by a seeded hash of (doc_id, copy) and of their text, and lie there in the order of the seeded hash.

Rates need one aggregation with partial sums; sources are few, but their table is only broadcast if it was counted as
small, and else joined on salted keys, so a source with a third of all rows is spread in both cases.

Null sources are a source of their own; null and empty texts have the size of their terminator, 1 byte. Rows that repeat
a doc_id get the same count, and so do all rows without one. Sources without a weight get none of the mix. An empty table gives no rows. Other columns
ride along; where one is called ``copy`` or ``shuffle_key``, the operator's column gets an underscore before its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

SEED, ALPHA = 11, 0.7
#: Sources that may be broadcast, and the parts that a source is dealt to beyond that.
FEW_SOURCES, SALTS = 10_000, 64


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash; the same in SQL engines that have md5."""
    head = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _cdf(rate: Column) -> Column:
    """The Poisson distribution's cumulative sums from 0 up to twelve standard deviations over the mean, summed in logs."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln(rate / k)
        total = s["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(s["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, step, lambda s: s["all"])).otherwise(F.array(F.lit(1.0)))


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, rate: target share over present share. ``weights`` (source, weight) need not sum to 1; without them a
    source's target share is its size to the power ``alpha``."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = stored(sizes, "sizes")
    whole = sizes.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    total, weight = float(whole["s"] or 0), float(whole["w"] or 0) or 1.0
    return sizes.select("source", (F.col("weight") / F.lit(weight) * F.lit(total) / F.col("size")).alias("rate"))


def replicated(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns) as often as drawn, with copy (from 1) and shuffle_key."""
    name = {x: free_name(docs.columns, x) for x in ("copy", "shuffle_key", "_source", "_cdf", "_n", "_salt", "_part")}
    rates = repetition_rates(docs, weights, alpha).select(F.col("source").alias(name["_source"]), _cdf(F.col("rate")).alias(name["_cdf"]))
    rates = stored(rates, "rates")
    same = F.col("source").eqNullSafe(F.col(name["_source"]))
    if rates.count() <= FEW_SOURCES:
        drawn = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(name["_salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parted = docs.withColumn(name["_part"], F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        drawn = parted.join(salted, same & (F.col(name["_part"]) == F.col(name["_salt"])))
    # the inverse is the number of sums under the uniform number: its place among them, once sorted in
    u = _uniform(F.lit(seed), F.col("doc_id"))
    place = F.array_position(F.sort_array(F.concat(F.col(name["_cdf"]), F.array(u))), u)
    count = drawn.withColumn(name["_n"], (place - 1).cast("int")).where(F.col(name["_n"]) > 0).select(*docs.columns, name["_n"])
    copies = count.withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["_n"])))).drop(name["_n"])
    keyed = copies.withColumn(name["shuffle_key"], F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.col(name["copy"])).cast("binary")))
    # texts of one doc_id have one key: dealt by text too, so that an id with very many rows fills no partition
    return keyed.repartition(F.xxhash64(name["shuffle_key"], "text")).sortWithinPartitions(name["shuffle_key"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return replicated(docs).select("doc_id", "source", "copy", "shuffle_key", "text")


ORACLE_SQL = f"""
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS size FROM documents GROUP BY source
), whole AS (
  SELECT sum(CAST(size AS DOUBLE)) AS s, sum(pow(CAST(size AS DOUBLE), {ALPHA})) AS w FROM sizes
), rates AS (
  SELECT source, pow(CAST(size AS DOUBLE), {ALPHA}) / w * s / size AS rate FROM sizes, whole
), steps AS (
  SELECT source, rate, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END AS part
  FROM rates, (SELECT unnest(range(0, (SELECT CAST(max(ceil(rate + 12 * sqrt(rate) + 30)) AS BIGINT) + 1 FROM rates))) AS k)
  WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)
), logs AS (
  SELECT source, k, sum(part) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS lg FROM steps
), cdf AS (
  SELECT source, k, sum(exp(lg)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM logs
), tables AS (
  SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, d.text,
         len(list_filter(t.cs, lambda c: c < (CAST(('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)) AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, source, text, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM drawn
)
SELECT doc_id, source, copy, md5('{SEED}:' || doc_id || ':' || copy) AS shuffle_key, text FROM copies
"""
