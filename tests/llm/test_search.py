import numpy as np
import pytest

from lodestrata.llm import multi_index as m


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, True) for i, v in rows], "vec_id long, embedding array<float>, score int, asks boolean")


def vectors(n=600, width=16, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)


def test_recall_and_scores_against_brute_force(spark):
    x = vectors()
    x[40:60] = x[0]  # many copies of one
    t = table(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [1.0, 2.0])])
    found = m.search(t, t.where("vec_id % 20 = 0"), block=200).toPandas()
    hits, y = 0, x.astype(np.float64)
    for q in range(0, 600, 20):
        score = y @ y[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:20]
        own = found[found.query_id == q].sort_values("rank")
        assert len(own) == 20 and own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing
        assert np.allclose(own.score, score[own.vec_id], atol=1e-12)
        ties = own.groupby("score").vec_id.apply(lambda s: s.is_monotonic_increasing)
        assert ties.all()
        hits += len(set(best) & set(own.vec_id))
    assert set(found.query_id) == set(range(0, 600, 20)) and found.vec_id.max() < 600
    assert hits / 600 >= 0.9


def test_probing_meets_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    index = m.Index(codes)
    for radius in (0, 3, 16, 40, 56, 128):
        for q in codes[:5]:
            far = np.bitwise_count(codes ^ q).sum(1)
            assert index.within(q, radius).tolist() == np.flatnonzero(far <= radius).tolist()


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    t = table(spark, [(20 * i, [1.0, float(i)]) for i in range(n)])
    assert m.search(t, t).count() == n * max(0, n - 1)


def test_repeated_ids_are_one_query_and_one_candidate(spark):
    rows = [(0, [1, 0]), (0, [0, 1]), (1, [2, 0]), (1, [2, 0]), (1, [0, 3]), (2, [1, 1]), (3, [0, 0.5]), (2**60 + 1, [1, 2]), (None, [9, 9])]
    t = table(spark, rows)
    for block in (100, 2):
        found = m.search(t, t.where("vec_id = 0"), k=4, block=block).collect()
        # the query's vector is [0, 1]
        assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 1, 3.0), (2, 2**60 + 1, 2.0), (3, 2, 1.0), (4, 3, 0.5)]
