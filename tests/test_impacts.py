import random

import pytest

from lodestrata.operators import impacts, retrieve


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, rng.choice("ab"), " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 40))) if i % 50 else None) for i in range(n)]
    rows += [(n + i, "a", "rare rare rare w1") for i in range(3)] + [(n + 10 + i, "a", "tied words here") for i in range(30)]
    return spark.createDataFrame(rows, "chunk_id long, workspace_id string, text string")


QUESTIONS = [(1, "a", "w1 w7 w30"), (2, "b", "W2, w2 w55!"), (3, "a", "rare"), (4, "b", "rare"), (5, "a", "tied words"), (6, "a", "..."), (7, None, "w1"), (8, "a", None), (9, "a", "w0 w1 w2 w3 w4 w5"), (10, "a", "rare w59")]


@pytest.mark.parametrize(("block", "probes"), [(16, 2), (1, 1), (5000, 2)])
def test_the_same_hits_as_without_blocks(spark, tmp_path, block, probes):
    chunks = corpus(spark)
    queries = spark.createDataFrame(QUESTIONS, "query_id int, workspace_id string, text string")
    impacts.write_index(chunks, str(tmp_path / "i"), block=block)
    found = impacts.top_k(queries, impacts.read_index(spark, str(tmp_path / "i")), 5, probes=probes)
    show = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    got = show(found.hits)
    assert got == show(retrieve.bm25_top_k(queries, chunks, 5)) and {g[0] for g in got} == {1, 2, 3, 5, 9, 10}
    work = {r.query_id: r for r in found.work.collect()}
    assert all(w.blocks == w.probed + w.read + w.skipped for w in work.values())
    if block == 16:
        assert work[10].skipped > work[10].blocks / 2  # few blocks hold the rare term
    if block == 5000:
        assert {(w.blocks, w.skipped) for w in work.values()} == {(1, 0)}


def test_an_empty_index(spark, tmp_path):
    queries = spark.createDataFrame(QUESTIONS[:2], "query_id int, workspace_id string, text string")
    impacts.write_index(corpus(spark).limit(0), str(tmp_path / "i"))
    found = impacts.top_k(queries, impacts.read_index(spark, str(tmp_path / "i")), 5)
    assert found.hits.count() == 0 and found.work.count() == 0


def test_what_is_in_a_block_is_not_shuffled(spark):
    rows, _ = impacts._block_rows(corpus(spark), "text", 16)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning(workspace_id") == 1 and "hashpartitioning(workspace_id" in plan and "term#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
