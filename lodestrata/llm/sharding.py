"""Two-pass external shuffle into shards.

Pass one scatters records to memory-sized buckets by a seeded hash of key and text. Pass two loads each bucket in one task,
puts it in canonical order (key, checksum, size, a hash of all columns; what ties then are equal rows), applies a
Fisher-Yates shuffle seeded by the bucket, and writes. The global order is bucket after bucket; with the bucket counts'
prefix sums each record knows its position, and position modulo the number of shards deals records out so that counts
differ by one at most (law ``rows``). A rerun, a lost executor or another partitioning of the input gives the same result.

The number of buckets follows the bytes: ``total / bucket_bytes``. Rows that repeat both key and text, and would fill more
than a ``HOT``-th of a bucket with that, are scattered by all their columns and the number of the copy. Copies are the same
in whatever order, so that they are counted rather than numbered: a group is one row with its count, made in part before
the shuffle, and then copied out. Bucket counts are a table of their own: prefix sums run in parts of ``RUN`` buckets, and
only one number for each part comes to the driver.

Null texts have size 1 and crc 0. Rows without a key, and rows that repeat one, get places of their own. An empty table
gives no rows; other columns ride along untouched, in their own types. Where one has the name of an added column, that one
gets an underscore before its name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, scratch, stored, table, tune, utf8

SHARDS, SEED, BUCKET_BYTES = 8, 20240607, 16 << 20
HOT, FEW_HOT, RUN = 8, 100_000, 4096


def _hashable(field: T.StructField) -> Column:
    """The column, or its JSON where it has a kind of value that can't be hashed."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{field.name}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{field.name}`")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of range(n): swaps i with a uniform j <= i, from the end down."""
    rng = np.random.Generator(np.random.Philox(seed))
    out = list(range(n))
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def _positions(sizes: DataFrame) -> DataFrame:
    """bucket, first: how many rows the buckets before each hold. ``sizes``: (bucket, n)."""
    parts = sizes.withColumn("part", F.floor(F.col("bucket") / RUN))
    totals = sorted(tuple(r) for r in parts.groupBy("part").agg(F.sum("n")).collect())  # one for RUN buckets
    before = dict(zip([k for k, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist(), strict=False))
    starts = sizes.sparkSession.createDataFrame(list(before.items()), "part long, start long")
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), "part").select("bucket", (F.col("start") + F.col("inside")).alias("first"))


def external_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with size, text_crc32, position, shard and slot; rows of one bucket follow each other in their new order."""
    tune(df.sparkSession)
    added = T.StructType([T.StructField(free_name(df.columns, f.name), f.dataType) for f in _ADDED])
    out = T.StructType([*df.schema.fields, *added.fields])
    names = [f.name for f in df.schema]
    bucket, first, tie, salt = (free_name([*names, *added.names], x) for x in ("_bucket", "_first", "_tie", "_salt"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    n_buckets = max(1, -(-(df.agg(F.sum(size)).first()[0] or 0) // bucket_bytes))

    with scratch(df.sparkSession) as keep:
        hashed = [F.xxhash64(F.lit(k), F.col(key), F.col(text)) for k in (0, 1)]
        groups = df.select(hashed[0].alias("a"), hashed[1].alias("b"), size.alias("size")).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("size").alias("size"))
        hot = stored(groups.where((F.col("n") > 1) & (F.col("n") * F.col("size") * HOT > bucket_bytes)).select(F.col("a").alias(bucket), F.col("b").alias(first)), "hot")
        n_hot = hot.limit(FEW_HOT + 1).count()
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= FEW_HOT else hot
            own = (hashed[0] == F.col(bucket)) & (hashed[1] == F.col(first))
            copies = df.join(hot, own, "left_semi").groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count("*").alias(salt))
            copies = copies.withColumn(salt, F.explode(F.sequence(F.lit(1).cast("long"), F.col(salt))))
            scatter = F.xxhash64(F.lit(seed), *[_hashable(f) for f in df.schema], F.col(salt))
            dealt = df.join(hot, own, "left_anti").withColumn(bucket, F.xxhash64(F.lit(seed), F.col(key), F.col(text))).unionByName(copies.withColumn(bucket, scatter).drop(salt))
        else:
            dealt = df.withColumn(bucket, F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
        dealt = dealt.withColumn(bucket, F.pmod(F.col(bucket), F.lit(n_buckets)))
        sizes = stored(dealt.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n")), "buckets")
        starts = stored(_positions(sizes), "starts").select(F.col("bucket").alias(bucket), F.col("first").alias(first))
        tied = dealt.withColumn(tie, F.xxhash64(*[_hashable(f) for f in df.schema]))
        ready = keep(tied.join(starts, bucket).select(*[F.col(f"`{n}`") for n in names], bucket, first, tie))

    def shuffle_bucket(group: tuple, rows: pyarrow.Table) -> pyarrow.Table:
        raw = utf8(rows[text].combine_chunks())
        crc, n_bytes = np.array([zlib.crc32(x) for x in raw], np.int64), np.array([len(x) + 1 for x in raw], np.int64)
        keyed = pyarrow.table([rows[key], pyarrow.array(crc), pyarrow.array(n_bytes), rows[tie]], names=["key", "crc", "size", "tie"])
        order = pyarrow.compute.sort_indices(keyed, sort_keys=[(c, "ascending") for c in keyed.column_names]).to_numpy()
        order = order[fisher_yates(len(raw), seed ^ (int(group[0].as_py()) + 1) << 20)]
        position = rows[first][0].as_py() + np.arange(len(raw))
        result = rows.select(names).take(pyarrow.array(order))
        for name, values in zip(added.names, (n_bytes[order], crc[order], position, (position % shards).astype(np.int32), position // shards), strict=True):
            result = result.append_column(name, pyarrow.array(values))
        return result

    return ready.groupBy(bucket).applyInArrow(shuffle_bucket, out)


_ADDED = T.StructType([T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("position", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])


def write_shards(df: DataFrame, path: str) -> None:
    """Write the shuffled records below ``path``, a folder for each shard, in slot order within each file. Each task writes
    its own buckets' part of every shard: nothing is shuffled again, and no task holds a shard."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external_shuffle(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
