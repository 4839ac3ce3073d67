import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import embed, retrieve
from lodestrata.settings import Settings

SMALL = Settings(dense_width=16, top_k=2)


def test_prefixes_and_unit_vectors(spark):
    df = spark.createDataFrame([(1, "passage: x y"), (2, "z")], "id int, text string")
    out = embed.embed_passages(df, embed.HashEncoder(16), "t", settings=SMALL).orderBy("id").collect()
    own = embed.HashEncoder(16)()
    assert np.allclose(out[0].dense, own(["passage: passage: x y"])[0], atol=1e-6) and abs(np.linalg.norm(out[1].dense) - 1) < 1e-6
    q = embed.embed_queries(df, embed.HashEncoder(16), "t", settings=SMALL).orderBy("id").first()
    assert np.allclose(q.dense, own(["query: passage: x y"])[0], atol=1e-6)


def test_bad_input_and_encoders(spark):
    blank = spark.createDataFrame([("ok",), (" \xa0",)], "text string")
    with pytest.raises(Exception, match="blank"):
        embed.embed_passages(blank, embed.HashEncoder(16), "t", settings=SMALL).collect()
    with pytest.raises(embed.EmbeddingError):
        embed.embed_passages("text", embed.HashEncoder(16))
    with pytest.raises(Exception, match="not 16"):
        embed.embed_passages(blank.where("text = 'ok'"), embed.HashEncoder(8), "wide", settings=SMALL).collect()
    with pytest.raises(embed.EmbeddingError, match="2 texts gave 1"):
        embed.checked(["a", "b"], [[0.0] * 16], 16)
    with pytest.raises(embed.EmbeddingError):
        embed.checked("ab", [[0.0] * 16] * 2, 16)

    def never():
        raise AssertionError("loaded for nothing")

    assert embed.embed_passages(blank.limit(0), never, "never", settings=SMALL).count() == 0


def chunks(spark):
    rows = [(1, "w", "p1", "the cat sat", [1.0, 0.0]), (2, "w", "p1", "the dog ran far", [0.6, 0.8]), (3, "w", "p2", "cat cat dog", [0.8, 0.6]), (4, "v", "p1", "cat", [1.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id int, workspace_id string, parent_id string, text string, dense array<double>")


def test_dense_search_stays_in_its_workspace(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "w", [1.0, 0.0]), (2, "v", [1.0, 0.0]), (3, "none", [1.0, 0.0])], "query_id int, workspace_id string, dense array<double>")
    want = {(1, 1, 1), (1, 3, 2), (2, 4, 1)}
    for few in (256, 0):
        monkeypatch.setattr(retrieve, "FEW_QUERIES", few)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in retrieve.dense_top_k(queries, chunks(spark), 2).collect()} == want


def test_bm25_is_the_formula(spark):
    queries = spark.createDataFrame([(1, "w", "Cat, cat!")], "query_id int, workspace_id string, text string")
    got = {r.chunk_id: r.score for r in retrieve.bm25_top_k(queries, chunks(spark), 5).collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / 2.5), 10 / 3
    score = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert set(got) == {1, 3} and math.isclose(got[1], score(1, 3)) and math.isclose(got[3], score(2, 3))


def test_fusion_and_parents(spark):
    hit = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id int, rank int")
    fused = retrieve.fused_top_k(hit([(1, 1, 1), (1, 2, 2)]), hit([(1, 2, 1), (1, 3, 2)]), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == [2, 1]
    parents = spark.createDataFrame([("w", "p1", "a.md", "A", "text one"), ("w", "p2", "b.md", None, "text two"), ("v", "p1", "c.md", "C", "other")], "workspace_id string, parent_id string, source_file string, section_label string, text string")
    found = retrieve.with_parents(hit([(1, 1, 2), (1, 2, 1), (1, 3, 3)]), chunks(spark), parents).orderBy("rank").collect()
    assert [(r.parent_id, r["rank"], r.source_file) for r in found] == [("p1", 1, "a.md"), ("p2", 3, "b.md")]


def test_ask_rewords_until_the_ceiling(spark):
    queries = spark.createDataFrame([(1, "w", "good", [1.0, 0.0]), (2, "w", "bad", [0.0, 1.0]), (3, "w", "hopeless", [-1.0, 0.0])], "query_id int, workspace_id string, text string, dense array<double>")
    parents = spark.createDataFrame([("w", p, f"{p}.md", p, "t") for p in ("p1", "p2")], "workspace_id string, parent_id string, source_file string, section_label string, text string")
    spaces = spark.createDataFrame([("w", True)], "id string, legal_flag boolean")
    calls = []

    def reword(open_, attempt):
        calls.append(sorted(r.query_id for r in open_.collect()))
        turned = F.when(F.col("query_id") == 2, F.expr("array(0.6D, 0.8D)")).otherwise(F.col("dense"))
        return open_.withColumn("text", F.concat("text", F.lit(f" {attempt}"))).withColumn("dense", turned)

    search = lambda q, c: retrieve.dense_top_k(q, c, 2)
    got = {r.query_id: r for r in retrieve.ask(queries, chunks(spark), parents, spaces, search, lambda h: h.where("score > 0.9"), reword, SMALL).collect()}
    assert calls == [[2, 3], [3]]
    assert got[1].kind == "answer" and got[1].retries == 0 and got[1].disclaimer and [s.file_name for s in got[1].sources] == ["p1.md"]
    assert got[2].kind == "answer" and got[2].searched == ["bad", "bad 1"]
    assert got[3].kind == "refusal" and got[3].sources == [] and got[3].searched == ["hopeless", "hopeless 1", "hopeless 1 2"] and got[3].refusal


def test_routing(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, dense array<double>")
    assert {r.query_id: r.workspace_id for r in retrieve.route_workspace(q, chunks(spark), 2).collect()} == {1: "w", 2: "w"}


def test_a_written_index_answers_like_the_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"w{i % 2}", " ".join(f"t{(i * k) % 11}" for k in range(1, 9))) for i in range(60)], "chunk_id long, workspace_id string, text string")
    queries = spark.createDataFrame([(1, "w0", "t1 t5 t5 none"), (2, "w1", "T3, t9!"), (3, "w1", "absent"), (4, "w2", "t1")], "query_id long, workspace_id string, text string")
    retrieve.write_index(chunks, str(tmp_path / "index"))
    index = retrieve.read_index(spark, str(tmp_path / "index"))
    want = sorted(tuple(r) for r in retrieve.bm25_top_k(queries, chunks, 5).collect())
    assert sorted(tuple(r) for r in retrieve.bm25_top_k(queries, index, 5).collect()) == want and {r[0] for r in want} == {1, 2}
    plan = retrieve.bm25_top_k(queries, index, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in plan  # only the terms' buckets are read


def test_traces_are_appended(spark, tmp_path):
    queries = spark.createDataFrame([(1, "w"), (2, "w")], "query_id long, workspace_id string")
    found = spark.createDataFrame([(1, "b.md", 1), (1, "a.md", 2), (1, "b.md", 3)], "query_id long, source_file string, rank int")
    tries = spark.createDataFrame([(1, 0, "q"), (1, 1, "q again")], "query_id long, attempt int, search string")
    rows = retrieve.traces(queries, found, tries)
    assert sorted((r.query_id, r.searched, r.files, r.retries) for r in rows.collect()) == [(1, ["q", "q again"], ["b.md", "a.md"], 1), (2, [], [], 0)]
    for _ in range(2):
        retrieve.append_traces(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
