import pytest
from pyspark.sql import functions as F

from lodestrata.operators import embed, evaluate, registry, sync
from lodestrata.settings import Settings
from lodestrata.streaming import watch

RESULTS = "eval_run_id string, question_id string, kind string, groundedness double, relevancy double, passed boolean, sourced boolean"


def gate(spark, rows):
    return evaluate.release_gate(spark.createDataFrame([("r", *x) for x in rows], RESULTS)).first()


def test_gate_on_both_sides_of_its_bounds(spark):
    inside, outside = [("i1", "in_scope", 0.90, 0.8, True, True)], [(f"o{i:02}", "out_of_scope", None, None, True, None) for i in range(20)]
    assert gate(spark, inside + outside).passed
    assert not gate(spark, [("i1", "in_scope", 0.8999, 0.8, True, True)] + outside).passed
    assert not gate(spark, inside + outside[:19]).passed
    bad = gate(spark, inside + outside[:19] + [("o19", "out_of_scope", None, None, False, None)])
    assert not bad.passed and bad.failing == ["o19"] and (bad.refusal_pass, bad.refusal_total) == (19, 20)
    unsourced = gate(spark, [("i1", "in_scope", 0.95, 0.8, True, False)] + outside)
    assert not unsourced.passed and unsourced.failing == ["i1"]
    assert not gate(spark, outside).passed


def test_caps_latency_and_details(spark):
    docs = spark.createDataFrame([("a", 1500, "active"), ("b", 1501, "active"), ("c", None, "removed")], "workspace_id string, page_count int, status string")
    many = docs.limit(0).union(spark.range(51).select(F.lit("d"), F.lit(1), F.lit("active")))
    assert {r.workspace_id: r.warning for r in evaluate.over_cap(docs.union(many)).collect()} == {"a": False, "b": True, "d": True}
    r = evaluate.latency(spark.createDataFrame([(float(i),) for i in range(101)], "seconds double")).first()
    assert (r.median, r.p95) == (50.0, 95.0)
    heads = spark.createDataFrame([("1",), ("2",)], "id string")
    rows = spark.createDataFrame([("1", "b", 2), ("1", "a", 1)], "run string, file_name string, n int")
    got = {r.id: [tuple(i) for i in r["items"]] for r in evaluate.with_details(heads, rows, "run", ["file_name", "n"], ["file_name"], "items").collect()}
    assert got == {"1": [("a", 1), ("b", 2)], "2": []}


def test_percentiles_from_merged_sketches(spark):
    times = spark.range(50_000).select((F.col("id") % 13).alias("day"), F.when(F.col("id") % 1000 > 0, (F.col("id") * 7919 % 50_000).cast("double")).alias("seconds"))
    found = evaluate.merged_latency(evaluate.latency_sketches(times, ("day",))).first()
    assert found.n == 49_950 and abs(found.median - 25_000) < 500 and abs(found.p95 - 47_500) < 500
    empty = evaluate.merged_latency(evaluate.latency_sketches(times.limit(0), ("day",)), ("day",))
    assert empty.count() == 0


def test_reports_are_dated_files(spark, tmp_path):
    import json

    rows = [("i1", "in_scope", 0.95, None, True, True)] + [(f"o{i:02}", "out_of_scope", None, None, i > 0, None) for i in range(20)]
    gated = evaluate.release_gate(spark.createDataFrame([("r", *x) for x in rows], RESULTS))
    r = evaluate.reports(gated, "/reports/", "2024-01-31").first()
    assert r.report_path == "/reports/run_date=2024-01-31/r.json"
    body = json.loads(r.body)
    assert body["failing"] == ["o00"] and body["passed"] is False and body["relevancy"] is None
    for day in ("2024-01-31", "2024-02-01"):
        evaluate.write_reports(gated, str(tmp_path / "reports"), day)
    assert sorted(str(x.run_date) for x in spark.read.json(str(tmp_path / "reports")).collect()) == ["2024-01-31", "2024-02-01"]


def counters(reg, run):
    r = reg.table("sync_run").where(F.col("id") == run).first()
    assert r.finished_at is not None
    return {k: r[k] for k in evaluate.RESULTS if r[k]}


def test_a_folder_over_three_syncs(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    settings = Settings(child_size=40, child_overlap=5, merge_below=20, split_above=60, dense_width=8)
    (folder / "a.md").write_text("# A\n" + "words and words\n\n" * 20)
    (folder / "b.txt").write_bytes(b"\xff\xfe")
    (folder / "c.md").write_text("  ")
    (folder / "d.xlsx").write_text("1")
    reg = registry.Registry(spark, str(tmp_path / "reg"), settings)
    store = sync.ChunkStore(reg, str(tmp_path / "store"))
    w = reg.create_workspace("w", f"file:{folder}")
    first = sync.sync(reg, store, w, embed.HashEncoder(8), settings)
    assert counters(reg, first) == {"added": 1, "failed": 1, "skipped": 2}
    before = {p.parent_id for p in store.parents(w).collect()}
    assert len(before) > 3 and store.children(w).where("size(dense) = 8").count() == store.children(w).count() > len(before)
    ids = {d.file_name: d.id for d in reg.list_documents(w).collect()}
    again = sync.sync(reg, store, w, embed.HashEncoder(8), settings)
    assert counters(reg, again) == {"unchanged": 3, "skipped": 1}
    (folder / "a.md").write_text("# A\nshort now\n")
    (folder / "b.txt").unlink()
    (folder / "e.md").write_text("new here")
    third = sync.sync(reg, store, w, embed.HashEncoder(8), settings)
    assert counters(reg, third) == {"added": 1, "changed": 1, "unchanged": 1, "removed": 1, "skipped": 1}
    left = {(p.source_file, p.parent_index) for p in store.parents(w).collect()}
    assert left == {("a.md", 0), ("e.md", 0)}
    docs = {d.file_name: d for d in reg.list_documents(w).collect()}
    assert docs["a.md"].id == ids["a.md"] and docs["b.txt"].status == "removed" and docs["c.md"].status == "skipped"
    (folder / "a.md").unlink()
    (folder / "e.md").unlink()
    (folder / "c.md").unlink()
    assert counters(reg, sync.sync(reg, store, w, None, settings)) == {"removed": 3, "skipped": 1}
    assert store.parents(w).count() == 0


def test_files_that_shrink_or_lose_all_rows_leave_nothing_behind(spark, tmp_path, monkeypatch):
    folder = tmp_path / "docs"
    folder.mkdir()
    settings = Settings(child_size=40, child_overlap=5, merge_below=20, split_above=60)
    (folder / "a.md").write_text("# A\n" + "words and words\n\n" * 20)
    (folder / "b.md").write_text("# B\nold body")
    reg = registry.Registry(spark, str(tmp_path / "reg"), settings)
    store = sync.ChunkStore(reg, str(tmp_path / "store"))
    w = reg.create_workspace("w", f"file:{folder}")
    sync.sync(reg, store, w, None, settings)
    old = sorted(store.parents(w).select("source_file", "parent_index").collect())
    (folder / "a.md").write_text("# A\nshort now")
    (folder / "b.md").write_text("# only a heading\n")

    def dies(*_):
        raise OSError("the driver went away")

    # at each point before the switch nothing has changed for readers
    for where, name in ((sync.ChunkStore, "write"), (sync.ChunkStore, "switched"), (registry.Registry, "_swap")):
        with monkeypatch.context() as m:
            if where is registry.Registry:
                whole, swaps = registry.Registry._swap, []
                m.setattr(where, name, lambda self, pointer: (swaps.append(1), dies() if len(swaps) == 2 else whole(self, pointer)))
            else:
                m.setattr(where, name, dies)
            with pytest.raises(OSError):
                sync.sync(reg, store, w, None, settings)
        assert sorted(store.parents(w).select("source_file", "parent_index").collect()) == old
    sync.sync(reg, store, w, None, settings)
    assert [(p.source_file, p.text) for p in store.parents(w).collect()] == [("a.md", "short now")]
    assert store.children(w).count() == 1 and store.vacuum() > 0
    assert [(p.source_file, p.text) for p in store.parents(w).collect()] == [("a.md", "short now")]


def test_a_run_that_died_is_closed_in_time(spark, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    store = sync.ChunkStore(reg, str(tmp_path / "store"))
    (tmp_path / "docs").mkdir()
    w = reg.create_workspace("w", f"file:{tmp_path}/docs")
    reg.insert_sync_run(w)
    with pytest.raises(sync.SyncInProgress):
        sync.sync(reg, store, w)
    sync.sync(reg, store, w, settings=Settings(run_expiry_s=0.0))
    assert reg.table("sync_run").where("finished_at is null").count() == 0


def test_a_second_sync_is_refused_and_a_failed_one_is_closed(spark, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    store = sync.ChunkStore(reg, str(tmp_path / "store"))
    w = reg.create_workspace("w", f"file:{tmp_path}/missing")
    with pytest.raises(FileNotFoundError):
        sync.sync(reg, store, w)
    assert reg.table("sync_run").where("finished_at is null").count() == 0
    reg.insert_sync_run(w)
    with pytest.raises(sync.SyncInProgress):
        sync.sync(reg, store, w)


def test_watching_hands_each_version_on_once(spark, tmp_path):
    seen = []
    arrive = lambda n, rows: spark.createDataFrame([(a, bytearray(b)) for a, b in rows], watch.ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        watch.watch(spark, str(tmp_path / "in"), lambda batch, n: seen.extend((r.file_name, r.fingerprint[-2:]) for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()

    arrive(1, [("a.md", b"x"), ("b.md", b"yy")])
    run()
    arrive(2, [("a.md", b"x"), ("a.md", b"xyz")])
    run()
    assert sorted(seen) == [("a.md", ":1"), ("a.md", ":3"), ("b.md", ":2")]
