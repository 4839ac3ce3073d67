import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import impacts, retrieve, sync
from lodestrata.operators.registry import Registry, RegistryBusy
from lodestrata.operators.upkeep import RETIRED, LiveIndex

CHUNK = "source_file string, parent_index int, parent_id string, section_label string, text string, workspace_id string"
QUESTIONS = [(1, "w1 w7 w30"), (2, "W2, w2 w55!"), (3, "rare"), (4, "tied words"), (5, "w0 w1 w2 w3 w4 w5"), (6, "..."), (7, None), (8, "gone")]


def made(spark, tmp_path, **options):
    registry = Registry(spark, str(tmp_path / "r"))
    store = sync.ChunkStore(registry, str(tmp_path / "s"))
    return store, LiveIndex(store, str(tmp_path / "i"), **options), registry.create_workspace("w", "/w")


def put(spark, store, space, version, files):
    """``files``: texts of chunks by name; a file without any goes."""
    rows = [(name, k, f"{name}-{k:02}", None, text, space) for name, texts in files.items() for k, text in enumerate(texts)]
    parents = spark.createDataFrame(rows, CHUNK)
    written = store.write(parents, parents.withColumn("child_index", F.lit(0)), version)
    moved = spark.createDataFrame([(space, name) for name in files], "workspace_id string, source_file string")
    with store.registry.transaction() as draft:
        draft["chunk_file"] = store.switched(draft["chunk_file"], moved, written)


def words(rng):
    return " ".join(rng.choices([f"w{i}" for i in range(60)], weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 30)))


def agrees(spark, store, index, space, k=4):
    queries = spark.createDataFrame([(q, space, t) for q, t in QUESTIONS], "query_id int, workspace_id string, text string")
    show = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    anew = store.children(space).withColumn("chunk_id", F.concat_ws("/", "parent_id", F.col("child_index").cast("string")))
    got = show(impacts.top_k(queries, index.read(space), k).hits)
    assert got == show(retrieve.bm25_top_k(queries, anew, k))
    return got


def test_an_index_that_follows_equals_one_built_anew(spark, tmp_path):
    rng = random.Random(2)
    store, index, space = made(spark, tmp_path, fanout=2, block=4)
    assert not index.update(space) and agrees(spark, store, index, space) == []
    files = {f"f{i:02}": [words(rng) for _ in range(rng.randint(1, 3))] for i in range(20)} | {"r": ["rare gone", "rare rare"], "t": ["tied words"] * 6, "n": [None, ""]}
    put(spark, store, space, "1", files)
    assert index.update(space) and not index.update(space)
    assert [(p.number, p.level) for p in index.parts(space)] == [(0, 0)]
    agrees(spark, store, index, space)
    # one grows, one shrinks, one goes, one comes
    put(spark, store, space, "2", {"f00": [words(rng) for _ in range(4)], "t": ["tied words"], "f01": [], "new": ["rare w1"], "r": ["rare"]})
    assert index.update(space)
    assert [p.level for p in index.parts(space)] == [1]
    got = agrees(spark, store, index, space)
    assert not [g for g in got if g[0] == 8]  # its term is in no chunk any more
    put(spark, store, space, "3", {"f02": [words(rng)], "f01": ["back again w1"]})
    assert index.update(space)
    assert sorted(p.level for p in index.parts(space)) == [0, 1]  # the later part makes chunks of the earlier one void
    agrees(spark, store, index, space)
    before = {p.id for p in index.parts()}
    assert index.vacuum() == 2 and {p.id for p in index.parts()} == before
    assert len(list((tmp_path / "i").iterdir())) == 2
    agrees(spark, store, index, space)
    # what is void outweighs what lives: all parts become one
    put(spark, store, space, "4", {f"f{i:02}": [] for i in range(2, 20)})
    assert index.update(space) and len(index.parts(space)) == 1
    agrees(spark, store, index, space)


def test_levels_fill_like_the_digits_of_a_number(spark, tmp_path):
    _, index, _ = made(spark, tmp_path, fanout=3)
    from lodestrata.operators.upkeep import Part

    index._read = lambda parts, what: spark.range(1).select(F.lit("w").alias("workspace_id"), F.lit(-9).alias("part"), F.lit("c").alias("chunk_id"))  # nothing is void
    parts, number = [], 0
    for _ in range(40):
        parts.append(Part(str(number), number, 0))
        together, level = index._due(parts)
        if together:
            number += 1
            parts = [p for p in parts if p not in together] + [Part(str(number), number, level)]
        number += 1
        assert len(parts) <= 2 * 4  # two of each level, and 40 < 3 ** 4
        assert max(sum(p.level == x for p in parts) for x in range(5)) <= 2
    assert RETIRED not in {p.level for p in parts}


def test_of_two_catch_ups_the_later_one_gives_up(spark, tmp_path):
    store, index, space = made(spark, tmp_path)
    put(spark, store, space, "1", {"a": ["one"]})
    listed = index._listed(space)
    assert index.update(space)
    with pytest.raises(RegistryBusy):
        index._switch(space, listed, [], [])


def test_a_registry_without_the_table_gets_it(spark, tmp_path):
    import json

    store, index, space = made(spark, tmp_path)
    at = tmp_path / "r" / "CURRENT"
    pointer = json.loads(at.read_text())
    del pointer["index_part"]
    at.write_text(json.dumps(pointer))
    (tmp_path / "r" / ".CURRENT.crc").unlink(missing_ok=True)
    assert index.parts() == []
    put(spark, store, space, "1", {"a": ["one"]})
    assert index.update(space) and len(index.parts(space)) == 1
    store.registry.delete_workspace(space)
    assert index.parts() == []
    assert index.vacuum() == 0 and index.vacuum(-1.0) == 1  # the folder of the lost workspace


def test_a_catch_up_cuts_blocks_where_chunks_are(spark, tmp_path):
    store, index, space = made(spark, tmp_path)
    put(spark, store, space, "1", {f"f{i}": ["one two", "two"] for i in range(9)})
    assert index.update(space)
    rows = index._blocks(index._read(index.parts(space), "chunks"), 3)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.term: r.df for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()} == {"one": 9, "two": 18}


def test_rows_that_repeat_a_chunk(spark, tmp_path):
    store, index, space = made(spark, tmp_path, block=2)
    twice = {"f0": ["one w1", "w1 w2", "w1 w2 w2", ""]}
    rows = [("f0", k // 2, f"f0-{k // 2}", None, text, space) for k, text in enumerate(twice["f0"])] + [("f1", 0, "f1-0", None, "w2 rare", space)]
    for version, some in (("1", rows), ("2", rows[3:])):
        parents = spark.createDataFrame(some, CHUNK)
        written = store.write(parents, parents.withColumn("child_index", F.lit(0)), version)
        with store.registry.transaction() as draft:
            draft["chunk_file"] = store.switched(draft["chunk_file"], spark.createDataFrame([(space, "f0"), (space, "f1")], "workspace_id string, source_file string"), written)
        assert index.update(space)
        assert agrees(spark, store, index, space)
