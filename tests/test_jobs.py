import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import jobs, registry, sync
from lodestrata.settings import Settings

SMALL = Settings(child_size=40, child_overlap=5, merge_below=20, split_above=60, wave_files=2)


@pytest.fixture
def space(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}.md").write_text(f"# F{i}\nbody of {i}")
    (folder / "x.bin").write_text("1")
    reg = registry.Registry(spark, str(tmp_path / "reg"), SMALL)
    return folder, reg, sync.ChunkStore(reg, str(tmp_path / "store")), reg.create_workspace("w", f"file:{folder}")


def reports(reg, run_id):
    return [(r.state, r.done, r.total) for r in jobs.progress(reg).where(F.col("run_id") == run_id).orderBy("seq").collect()]


def test_a_cancelled_job_leaves_whole_waves_and_the_next_one_goes_on(spark, space):
    folder, reg, store, w = space

    def watch(job, row):
        if row["state"] == "stored":
            with pytest.raises(registry.SyncInProgress):
                reg.delete_workspace(w)
            job.cancel()

    job = jobs.start_sync(reg, store, w, settings=SMALL, watch=watch)
    with pytest.raises(registry.SyncInProgress):
        jobs.start_sync(reg, store, w, settings=SMALL)
    assert job.wait(300) and isinstance(job.error, sync.SyncCancelled)
    assert reports(reg, job.run_id) == [("scanned", 0, 5), ("stored", 2, 5), ("cancelled", 2, 5)]
    assert [d.file_name for d in reg.list_documents(w).collect()] == ["f0.md", "f1.md"]
    assert {p.source_file for p in store.parents(w).collect()} == {"f0.md", "f1.md"}
    row = reg.table("sync_run").where(F.col("id") == job.run_id).first()
    assert row.finished_at is not None and (row.added, row.skipped) == (2, 0)
    again = jobs.start_sync(reg, store, w, settings=SMALL)
    assert again.wait(300) and again.error is None
    assert reports(reg, again.run_id) == [("scanned", 0, 3), ("stored", 2, 3), ("stored", 3, 3), ("finished", 3, 3)]
    row = reg.table("sync_run").where(F.col("id") == again.run_id).first()
    assert (row.added, row.unchanged, row.skipped) == (3, 2, 1)
    assert {p.source_file for p in store.parents(w).collect()} == {f"f{i}.md" for i in range(5)}
    assert jobs.state(reg, again.run_id)["state"] == "finished" and jobs.state(reg, "none") is None
    assert {r.run_id: r.state for r in jobs.latest(reg).collect()} == {job.run_id: "cancelled", again.run_id: "finished"}
    reg.delete_workspace(w)


def test_a_cancel_ends_the_wave_at_work(spark, space):
    folder, reg, store, w = space

    def slow(data):
        time.sleep(120)

    job = jobs.start_sync(reg, store, w, settings=SMALL, readers={"md": slow}, watch=lambda job, row: threading.Timer(4, job.cancel).start() if row["state"] == "scanned" else None)
    assert job.wait(100)
    assert reports(reg, job.run_id)[-1] == ("cancelled", 0, 5) and reg.list_documents(w).count() == 0
    assert reg.table("sync_run").where("finished_at is null").count() == 0


def test_a_job_that_died_is_lost_and_taken_over(spark, space, monkeypatch):
    folder, reg, store, w = space
    quick = registry.Registry(spark, reg.path, Settings(lease_s=0.5))
    run_id = sync.open_run(quick, w)  # and its driver goes away
    quick._write_text(quick._path(f"{quick.path}/progress/{run_id}-000000.json"), '{"run_id": "%s", "seq": 0, "at": "2024-01-01T00:00:00", "state": "scanned", "done": 0, "total": 5}\n' % run_id, True)
    assert jobs.state(reg, run_id)["state"] == "scanned"
    with pytest.raises(registry.SyncInProgress):
        sync.open_run(reg, w)
    time.sleep(1)
    assert jobs.state(quick, run_id)["state"] == "lost"
    other = sync.open_run(quick, w)
    rows = {r.id: r.finished_at is None for r in reg.table("sync_run").collect()}
    assert rows == {run_id: False, other: True}
    # a run that is worked at keeps its lease for longer than that lasts
    with quick.run_lease(other):
        time.sleep(1.5)
        assert quick.open_runs(quick.table("sync_run"), w) == ([other], [])


def test_a_commit_twice_as_long_as_its_lock_holds(spark, space):
    _, reg, _, w = space
    slow = registry.Registry(spark, reg.path, Settings(lock_expiry_s=1.0))
    hasty = registry.Registry(spark, reg.path, Settings(lock_expiry_s=1.0, busy_timeout_s=0.2))
    with slow.transaction() as draft:
        time.sleep(2.2)
        with pytest.raises(registry.RegistryBusy):
            hasty.rename_workspace(w, "hasty")
        draft["workspace"] = draft["workspace"].withColumn("name", F.lit("slow"))
    assert reg.get_workspace(w).name == "slow"


def test_a_job_that_fails_says_so(spark, space):
    folder, reg, store, w = space
    gone = reg.create_workspace("gone", f"file:{folder}/none")
    job = jobs.start_sync(reg, store, gone, settings=SMALL)
    assert job.wait(100) and isinstance(job.error, FileNotFoundError)
    assert jobs.state(reg, job.run_id)["error"].startswith("FolderNotFound")
