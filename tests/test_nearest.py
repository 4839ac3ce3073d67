import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions.vectors import dot
from lodestrata.operators import nearest, retrieve

HITS = "query_id long, workspace_id string, dense array<float>"


def whole(queries, chunks, k, within=True):
    """All products, each summed up from left to right; null ones last, of equal ones the smaller chunk_id first."""
    out = {}
    for q, space, y in queries:
        for other in {w for _, w, _ in chunks} if not within else {space} - {None}:
            def score(x):
                bad = x is None or y is None or len(x) != len(y) or None in x or None in y
                return None if bad else float(np.cumsum([0.0, *(np.float32(a) * np.float64(np.float32(b)) for a, b in zip(x, y))])[-1])
            rows = sorted(((s is None, -s if s is not None else 0.0, c) for c, w, x in chunks if w == other for s in [score(x)]))
            out[q, other] = [c for _, _, c in rows[:k]]
    return {key: v for key, v in out.items() if v}


def made():
    rng = random.Random(3)
    vector = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]
    same = vector()
    chunks = [(i, rng.choice("ab"), vector()) for i in range(700)] + [(1000 + i, "a", same) for i in range(300)] + [(2000, None, same), (2001, "c", vector())]
    odd = [(3000, "a", None), (3001, "b", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3002, "c", [1.0]), (3003, "a", [0.0] * 6)]
    queries = [(i, rng.choice("abc"), vector()) for i in range(60)] + [(100, "a", same), (101, None, same), (102, "d", same)]
    return queries, chunks, odd


def test_blocks_find_what_all_products_give(spark, monkeypatch):
    queries, chunks, odd = made()
    for name, n in (("QUERIES", 20), ("VECTORS", 90), ("AT_ONCE", 7)):
        monkeypatch.setattr(nearest, name, n)
    for rows, asked in ((chunks, queries), (chunks + odd, queries + [(103, "a", None), (104, "c", [2.0])])):
        q, c = spark.createDataFrame(asked, HITS), spark.createDataFrame(rows, HITS).withColumnRenamed("query_id", "chunk_id")
        got = {}
        for r in retrieve.dense_top_k(q, c, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {key: v for (key, _), v in whole(asked, rows, 5).items()}
    q, c = spark.createDataFrame(queries, HITS), spark.createDataFrame(chunks, HITS).withColumnRenamed("query_id", "chunk_id")
    found = retrieve.top(retrieve._nearest(q, c, 5, within=False).select(F.struct("query_id", "workspace_id").alias("query_id"), "chunk_id", "score"), 5, F.col("score"), "chunk_id")
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault((r.query_id.query_id, r.query_id.workspace_id), []).append(r.chunk_id)
    assert got == whole(queries, chunks, 5, within=False)


def test_odd_vectors_meet_by_blocks(spark, monkeypatch):
    """Any vectors give what a join of all pairs gives, without one, and what goes on is k rows a query and block."""
    rng = random.Random(8)
    inf, nan, wide = float("inf"), float("nan"), lambda n: [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]
    kinds = [lambda: None, lambda: [], lambda: [1.0, None, 2.0, 0.5], lambda: [nan, *wide(3)], lambda: [inf, *wide(3)], lambda: [-inf, *wide(3)], lambda: [1e38] * 4, lambda: [0.0] * 4, lambda: [-0.0] * 4, lambda: wide(3), lambda: [0.0, inf, 1.0, 1.0]]
    rows = [(i, rng.choice("ab"), rng.choice(kinds)() if rng.random() < 0.5 else wide(4)) for i in range(600)] + [(900, "c", None), (901, "c", wide(4)), (902, "c", [nan] * 4), (903, None, wide(4)), (None, "c", wide(4))]
    asked = [(i, rng.choice("abcd"), kinds[i % len(kinds)]() if i % 2 else wide(4)) for i in range(60)] + [(99, None, wide(4))]
    q, c = spark.createDataFrame(asked, HITS), spark.createDataFrame(rows, HITS).withColumnRenamed("query_id", "chunk_id")
    pairs = q.withColumnRenamed("dense", "y").join(c, "workspace_id").select("query_id", "chunk_id", dot(F.col("y"), F.col("dense")).alias("score"))
    show = lambda df: [str(tuple(r)) for r in df.select("query_id", "rank", "chunk_id", F.col("score") + 0.0).orderBy("query_id", "rank").collect()]
    want = show(retrieve.top(pairs, 5, F.col("score"), "chunk_id"))
    for name, n in (("QUERIES", 20), ("VECTORS", 90), ("AT_ONCE", 16)):
        monkeypatch.setattr(nearest, name, n)
    assert show(retrieve.dense_top_k(q, c, 5)) == want
    crossed = q.select("query_id", F.col("dense").alias("y")).crossJoin(c).select(F.struct("query_id", "workspace_id").alias("query_id"), "chunk_id", dot(F.col("y"), F.col("dense")).alias("score"))
    met = retrieve._nearest(q, c, 5, within=False)
    assert "Join" not in met._jdf.queryExecution().toString()
    assert show(retrieve.top(met.select(F.struct("query_id", "workspace_id").alias("query_id"), "chunk_id", "score"), 5, F.col("score"), "chunk_id")) == show(retrieve.top(crossed, 5, F.col("score"), "chunk_id"))


def test_width_is_that_of_most(spark, monkeypatch):
    """One short vector, read first, doesn't make all others odd."""
    vector = lambda n: F.array(*[F.rand(i).cast("float") for i in range(n)])
    rows = lambda at, to, n: spark.range(at, to, 1, 1).select(F.col("id").alias("chunk_id"), F.lit("w").alias("workspace_id"), vector(n).alias("dense"))
    chunks = rows(0, 1, 2).unionByName(rows(1, 2001, 4))
    asked = chunks.where("chunk_id % 50 = 1").withColumnRenamed("chunk_id", "query_id")
    calls, dense = [], nearest.dense
    monkeypatch.setattr(nearest, "dense", lambda *a, **b: calls.append(a[3:5]) or dense(*a, **b))
    assert retrieve._nearest(asked, chunks, 3).where("chunk_id > 0").count() >= 40 * 3
    assert calls == [(40, 2000), (40, 1)]


def test_pairs_are_not_shuffled(spark):
    """What goes on from a block of chunks is k rows a query, whatever the block holds."""
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.lit("w").alias("workspace_id"), F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("dense"))
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.lit("w").alias("workspace_id"), F.array(*[F.rand(9 + i).cast("float") for i in range(4)]).alias("dense"))
    met = retrieve._nearest(asked, chunks, 3)
    blocks = min(2 * spark.sparkContext.defaultParallelism, 2000 // nearest.LEAST)
    assert met.count() <= 40 * 3 * blocks < 40 * 2000 / 10


def test_best_products_are_picked_by_groups():
    """The best of all products, ties and copies included, whatever the groups are, from the products of few queries at once."""
    rng = np.random.default_rng(2)
    for n, k in ((1, 5), (5, 5), (41, 5), (700, 1), (1300, 20)):
        x, y = (rng.integers(-1, 2, (m, 6)).astype(float) for m in (n, 70))
        x[n // 2 :] = x[: n - n // 2]
        found = [np.concatenate(f) for f in zip(*nearest.best_vectors(y, x, k))]
        all_ = (y[:, None] * x[None]).sum(2)
        want = [(i, j, all_[i, j]) for i in range(70) for j in np.argsort(-all_[i], kind="stable")[:k]]
        assert list(zip(*found)) == want
    x, y = rng.normal(size=(20_000, 8)), rng.normal(size=(256, 8))
    tracemalloc.start()
    found = sum(len(row) for row, _, _ in nearest.best_vectors(y, x, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 256 * 5 and peak < 30e6


def test_sums_of_terms_by_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(300)], k=n))
    chunks = [(i, rng.choice("ab"), text(rng.randint(1, 60))) for i in range(500)] + [(600 + i, "a", "tied words") for i in range(40)] + [(700, "a", None), (701, "b", "")]
    queries = [(i, rng.choice("ab"), text(40)) for i in range(50)] + [(60, "a", "tied words"), (61, "a", None), (62, None, "w1"), (63, "c", "w1")]
    q, c = spark.createDataFrame(queries, "query_id long, workspace_id string, text string"), spark.createDataFrame(chunks, "chunk_id long, workspace_id string, text string")
    show = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = show(retrieve.bm25_top_k(q, c, 5))
    for name, n in (("QUERIES", 20), ("CHUNKS", 90), ("AT_ONCE", 7), ("NARROW", 33), ("HOT", 4)):
        monkeypatch.setattr(nearest, name, n)
    assert show(retrieve.bm25_top_k(q, c, 5)) == want and [g[2] for g in want if g[0] == 60] == [600, 601, 602, 603, 604]


def test_terms_are_counted_within_rows(spark):
    rows = spark.createDataFrame([(1, "b a b B c"), (2, ""), (3, None)], "chunk_id long, text string").withColumn("workspace_id", F.lit("w"))
    got = {r.chunk_id: (r.length, r.terms, r.tfs) for r in retrieve.counted(rows).collect()}
    assert got[1] == (5, ["a", "b", "c"], [1, 3, 1]) and not got[2][1] and not got[3][1]
    plan = retrieve.sparse_index(rows).postings._jdf.queryExecution().toString()
    assert "Aggregate" not in plan
    twice = rows.unionByName(rows)
    assert {(r.term, r.tf) for r in retrieve.sparse_index(twice).postings.collect()} == {("a", 2), ("b", 6), ("c", 2)}
