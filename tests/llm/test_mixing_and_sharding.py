import zlib

import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import sharding, source_mix

from .fixtures import corpus, frame


def test_copies_follow_the_distribution(spark):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 4 == 0, "small").when(F.col("id") % 4 < 3, "large").alias("source"))
    weights = spark.createDataFrame([("small", 2.0), ("large", 1.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    got = {r.source: r["count"] for r in source_mix.replicated(docs, weights).groupBy("source").count().collect()}
    whole = 40000 / 9 * 9
    rates = {r.source: r.rate for r in source_mix.repetition_rates(docs, weights).collect()}
    sizes = {"small": 10000, "large": 20000, None: 10000}
    for s, n in got.items():
        assert abs(n - rates[s] * sizes[s]) < 5 * (rates[s] * sizes[s]) ** 0.5
    assert abs(sum(rates[s] * sizes[s] for s in sizes) - whole) < 1
    again = source_mix.replicated(docs, weights)
    assert again.exceptAll(source_mix.replicated(docs, weights)).isEmpty()


def test_many_sources_take_the_salted_way(spark, monkeypatch):
    docs = frame(spark, corpus())
    few = source_mix.replicated(docs)
    monkeypatch.setattr(source_mix, "FEW_SOURCES", 0)
    many = source_mix.replicated(docs)
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty() and few.columns[: len(docs.columns)] == docs.columns


def test_mix_of_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "x")]
    assert source_mix.replicated(frame(spark, rows).where("doc_id = 9")).count() == 0
    assert source_mix.replicated(frame(spark, rows)).where("copy < 1").count() == 0
    clash = source_mix.replicated(frame(spark, rows).withColumn("Copy", F.lit(7)).withColumn("_cdf", F.lit(8)))
    assert clash.where("Copy <> 7 or _cdf <> 8 or _copy < 1").count() == 0 and "shuffle_key" in clash.columns


def test_shards_are_gapless_and_even(spark):
    rows = corpus(8, 50) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = frame(spark, rows)
    out = sharding.external_shuffle(docs, bucket_bytes=2000)
    found = out.select("doc_id", "text", "size", "text_crc32", "shard", "slot", "component_id").collect()
    assert len(found) == len(rows) and all(r.component_id == 5 for r in found)
    for r in found:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert out.drop("text").exceptAll(sharding.external_shuffle(docs.repartition(5), bucket_bytes=2000).drop("text")).isEmpty()


def test_fisher_yates_is_uniform_enough():
    seen = [0] * 6
    for seed in range(6000):
        seen[{(0, 1, 2): 0, (0, 2, 1): 1, (1, 0, 2): 2, (1, 2, 0): 3, (2, 0, 1): 4, (2, 1, 0): 5}[tuple(sharding.fisher_yates(3, seed).tolist())]] += 1
    assert max(seen) - min(seen) < 200


def test_shards_written_and_empty(spark, tmp_path):
    docs = frame(spark, corpus())
    sharding.write_shards(sharding.external_shuffle(docs), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
    assert sharding.external_shuffle(docs.where("doc_id < 0")).count() == 0
    clash = sharding.external_shuffle(docs.withColumn("Shard", F.lit(11)).withColumn("_bucket", F.lit(1)))
    assert clash.where("Shard <> 11 or _shard > 7").count() == 0 and clash.count() == docs.count()


def test_hot_rows_are_split_and_types_survive(spark):
    from pyspark.sql import types as T

    big = 2**60 + 1
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rider", T.LongType()), T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))])
    rows = [(big + i, f"text {i}", big + i if i % 2 else None, {"a": i}) for i in range(40)] + [(None, "same text " * 5, None, None)] * 300 + [(7, "hot key " + str(i), 1, None) for i in range(100)]
    docs = spark.createDataFrame(rows, schema)
    out = sharding.external_shuffle(docs, bucket_bytes=1500)
    found = out.collect()
    assert sorted((str(r.doc_id), r.text, str(r.rider), str(r.m)) for r in found) == sorted((str(i), t, str(x), str(m)) for i, t, x, m in rows)
    assert sorted(r.position for r in found) == list(range(len(rows)))
    assert all((r.shard, r.slot) == (r.position % 8, r.position // 8) for r in found)
    places = lambda df: sorted((str(r.doc_id), r.text, r.position, r.shard, r.slot) for r in sharding.external_shuffle(df, bucket_bytes=1500).collect())
    assert places(docs.repartition(2)) == places(docs.repartition(7)) == places(docs.orderBy("text").coalesce(1))  # data alone decide
    same = sorted(r.position for r in found if r.text.startswith("same"))
    assert max(b - a for a, b in zip(same, same[1:])) < 100  # spread over all buckets


def test_positions_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    sizes = [(b, 1 + b % 4) for b in range(0, 40, 2)]
    got = {r.bucket: r.first for r in sharding._positions(spark.createDataFrame(sizes, "bucket long, n long")).collect()}
    at = 0
    for b, n in sizes:
        assert got[b] == at
        at += n


def test_the_query_equals_a_plain_version(spark, monkeypatch):
    folder, bucket_bytes = "/root/testdata/sf0.001", 20_000
    monkeypatch.setattr(sharding.external_shuffle, "__defaults__", ("doc_id", "text", sharding.SHARDS, sharding.SEED, bucket_bytes))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    raw = {i: (t or "").encode() for i, t in docs}
    n = -(-sum(len(x) + 1 for x in raw.values()) // bucket_bytes)
    buckets = [[] for _ in range(n)]
    for i, t in docs:
        h = xxhash.xxh64_intdigest(sharding.SEED.to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), h)
        h = h if t is None else xxhash.xxh64_intdigest(raw[i], h)
        buckets[(h - (h >> 63 << 64)) % n].append(i)
    want, position = {}, 0
    for b, ids in enumerate(buckets):
        ids.sort()
        for k in sharding.fisher_yates(len(ids), sharding.SEED ^ (b + 1) << 20):
            want[ids[k]] = (len(raw[ids[k]]) + 1, zlib.crc32(raw[ids[k]]), "rows", position % 8, position // 8, None)
            position += 1
    got = sharding.query(spark, folder).collect()
    assert n > 10 and len(got) == len(docs) and {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in got} == want


def test_very_long_texts_and_large_ids(spark):
    big = 2**60 + 1
    rows = [(big, "x" * 3_000_000), (big, "another text"), (None, "y" * 3_000_000), (5, ""), (6, None)]
    out = sharding.external_shuffle(frame(spark, rows), bucket_bytes=1 << 20).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(i), len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    mixed = source_mix.replicated(frame(spark, rows), alpha=1.0).collect()
    texts = {(i, t) for i, t in rows}
    assert all((r.doc_id, r.text) in texts for r in mixed) and {r.copy for r in mixed} <= set(range(1, 40))
