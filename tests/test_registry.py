import threading

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import registry as r
from lodestrata.settings import Settings


@pytest.fixture
def reg(spark, tmp_path):
    return r.Registry(spark, str(tmp_path / "reg"), Settings(busy_timeout_s=20))


def test_reading_never_creates(reg, tmp_path):
    for read in (reg.list_workspaces, lambda: reg.list_documents("x"), lambda: reg.get_workspace("x")):
        with pytest.raises(r.RegistryNotFound):
            read()
    assert not (tmp_path / "reg").exists()


def test_workspaces(reg):
    b, a = reg.create_workspace("  beta\xa0", "/b"), reg.create_workspace("alpha", "/a", legal_flag=True)
    assert [(w.id, w.name, w.legal_flag) for w in reg.list_workspaces().collect()] == [(a, "alpha", True), (b, "beta", False)]
    for bad in ("", " \t", "x" * 101, None):
        with pytest.raises(r.InvalidWorkspaceName):
            reg.create_workspace(bad, "/c")
    with pytest.raises(r.InvalidFolder):
        reg.create_workspace("c", "  ")
    with pytest.raises(r.DuplicateWorkspace):
        reg.create_workspace(" alpha ", "/c")
    with pytest.raises(r.ConstraintViolation):
        reg.create_workspace("c", None)
    with pytest.raises(r.DuplicateWorkspace):
        reg.rename_workspace(b, "alpha")
    reg.rename_workspace(b, "beta")
    reg.rename_workspace(b, "gamma")
    reg.set_legal_flag(b, True)
    assert (reg.get_workspace(b).name, reg.get_workspace(b).legal_flag) == ("gamma", True)
    with pytest.raises(r.WorkspaceNotFound):
        reg.get_workspace("nowhere")
    with pytest.raises(r.WorkspaceNotFound):
        reg.rename_workspace("nowhere", "x")
    reg.create_workspace("x" * 100, "/c")


def test_cascade_set_null_and_isolation(reg):
    w, other = reg.create_workspace("w", "/w"), reg.create_workspace("o", "/o")
    for ws in (w, other):
        d = reg.insert_document(ws, "a.md", "md", "sha256:x:1")
        run = reg.insert_sync_run(ws, finished_at=r.now(), added=1)
        reg.insert_sync_item(run, "a.md", "added", d)
        e = reg.insert_eval_run(ws, True, 0.95, 0.9, 20, 20)
        reg.insert_eval_result(e, "q1", "in_scope", True, 0.9, None)
    reg.delete_document(d)
    items = {i.document_id for i in reg.table("sync_item").collect()}
    assert len(items) == 2 and None in items
    reg.delete_workspace(w)
    assert {t: reg.table(t).count() for t in r.TABLES} == {"workspace": 1, "document": 0, "sync_run": 1, "sync_item": 1, "eval_run": 1, "eval_result": 1, "chunk_file": 0, "index_part": 0}
    with pytest.raises(r.WorkspaceNotFound):
        reg.delete_workspace(w)


def test_constraints_roll_back(reg):
    w = reg.create_workspace("w", "/w")
    reg.insert_document(w, "a.md", "md", "h")
    for bad in (
        lambda: reg.insert_document(w, "a.md", "md", "h"), lambda: reg.insert_document("nowhere", "b.md", "md", "h"), lambda: reg.insert_document(w, "b.md", "md", "h", status="odd"),
        lambda: reg.insert_document(w, "b.md", "md", None), lambda: reg.insert_sync_item("nowhere", "a", "added"), lambda: reg.insert_eval_result("nowhere", "q", "in_scope", True),
    ):
        with pytest.raises(r.ConstraintViolation):
            bad()
    with pytest.raises(ZeroDivisionError), reg.transaction() as draft:
        draft["document"] = draft["document"].limit(0)
        1 / 0
    assert [d.file_name for d in reg.list_documents(w).collect()] == ["a.md"]


def test_writers_wait_for_each_other(spark, reg):
    w = reg.create_workspace("w", "/w")
    entered, go = threading.Event(), threading.Event()

    def slow():
        with reg.transaction() as draft:
            entered.set()
            go.wait(10)
            draft["workspace"] = draft["workspace"].withColumn("folder_path", F.lit("/slow"))

    t = threading.Thread(target=slow)
    t.start()
    entered.wait(10)
    with pytest.raises(r.RegistryBusy):
        r.Registry(spark, reg.path, Settings(busy_timeout_s=0.3)).rename_workspace(w, "x")
    threading.Timer(0.5, go.set).start()
    reg.rename_workspace(w, "after")
    t.join()
    assert (reg.get_workspace(w).folder_path, reg.get_workspace(w).name) == ("/slow", "after")


def test_upsert_replaces_by_file(spark, reg):
    w = reg.create_workspace("w", "/w")
    reg.insert_document(w, "a.md", "md", "h1", id_="1")
    fresh = reg._rows("document", [{"id": "1", "workspace_id": w, "file_name": "a.md", "file_type": "md", "content_hash": "h2", "status": "active"}, {"id": "2", "workspace_id": w, "file_name": "b.md", "file_type": "md", "content_hash": "h", "status": "active"}])
    with reg.transaction() as draft:
        draft["document"] = r.upserted(draft["document"], fresh)
    assert [(d.id, d.content_hash) for d in reg.list_documents(w).collect()] == [("1", "h2"), ("2", "h")]


def test_inserts_add_folders_until_a_table_is_written_anew(reg, monkeypatch):
    monkeypatch.setattr(r, "PARTS", 3)
    w = reg.create_workspace("w", "/w")
    sizes = []
    for i in range(5):
        reg.insert_document(w, f"{i}.md", "md", "h")
        sizes.append(len(reg._pointer()["document"]))
    assert sizes == [2, 3, 1, 2, 3] and reg.list_documents(w).count() == 5
    with pytest.raises(r.ConstraintViolation):
        reg.insert_document(w, "3.md", "md", "h")
    assert reg.list_documents(w).count() == 5


def test_the_lock_of_a_dead_writer_expires(spark, reg, tmp_path):
    w = reg.create_workspace("w", "/w")
    (tmp_path / "reg" / "LOCK").write_text("someone who died")
    with pytest.raises(r.RegistryBusy):
        r.Registry(spark, reg.path, Settings(busy_timeout_s=0.3)).rename_workspace(w, "x")
    r.Registry(spark, reg.path, Settings(busy_timeout_s=0.3, lock_expiry_s=0.0)).rename_workspace(w, "x")
    assert reg.get_workspace(w).name == "x" and not (tmp_path / "reg" / "LOCK").exists()


def test_a_writer_whose_lock_was_taken_gives_up(spark, reg, tmp_path):
    w = reg.create_workspace("w", "/w")
    with pytest.raises(r.RegistryBusy), reg.transaction() as draft:
        draft["workspace"] = draft["workspace"].withColumn("folder_path", F.lit("/slow"))
        r.Registry(spark, reg.path, Settings(lock_expiry_s=-1.0)).rename_workspace(w, "fast")
    assert (reg.get_workspace(w).name, reg.get_workspace(w).folder_path) == ("fast", "/w")
