from lodestrata.operators import diff

SCAN = "file_name string, file_type string, scan_state string, digest string, size_bytes bigint"
DOCS = "id string, file_name string, file_type string, content_hash string, status string"


def changes(spark, scan, docs):
    rows = diff.detect_changes(spark.createDataFrame(scan, SCAN), spark.createDataFrame(docs, DOCS)).collect()
    return {r.file_name: (r.change, r.document_id) for r in rows}


def test_every_transition_in_one_pass(spark):
    ok = lambda name, digest="d", size=1: (name, "md", "ok", digest, size)
    scan = [ok("new"), ok("same"), ok("other", "e"), ok("back"), ok("forged", "d", 2), ok("garbled"), ok("failed"), ("old.pptx", "pptx", "unsupported", None, None), ("locked", "md", "unreadable", None, None), ("fresh-locked", "md", "unreadable", None, None)]
    docs = [(f"id-{n}", n, "md", h, s) for n, h, s in [
        ("same", "sha256:d:1", "active"), ("other", "sha256:d:1", "active"), ("back", "sha256:d:1", "removed"), ("forged", "sha256:d:1", "active"), ("garbled", "sha256:d", "active"), ("failed", "sha256:d:1", "failed"),
        ("gone", "sha256:d:1", "active"), ("gone-failed", "sha256:d:1", "failed"), ("gone-removed", "sha256:d:1", "removed"), ("old.pptx", "sha256:d:1", "active"), ("locked", "sha256:d:1", "active"),
    ]]
    assert changes(spark, scan, docs) == {
        "new": ("new", None), "same": ("unchanged", "id-same"), "other": ("changed", "id-other"), "back": ("new", "id-back"), "forged": ("changed", "id-forged"), "garbled": ("changed", "id-garbled"),
        "failed": ("unchanged", "id-failed"), "gone": ("removed", "id-gone"), "gone-failed": ("removed", "id-gone-failed"), "old.pptx": ("removed", "id-old.pptx"),
    }


def test_empty_sides(spark):
    assert changes(spark, [], []) == {}
    assert changes(spark, [], [("1", "a", "md", "x", "active")]) == {"a": ("removed", "1")}
    assert changes(spark, [("a", "md", "ok", "d", 0)], []) == {"a": ("new", None)}


def test_scopes_never_mix(spark):
    scan = spark.createDataFrame([("w1", "a", "md", "ok", "d", 1)], "ws string, " + SCAN)
    docs = spark.createDataFrame([("w2", "1", "a", "md", "sha256:d:1", "active")], "ws string, " + DOCS)
    assert {(r.ws, r.change) for r in diff.detect_changes(scan, docs, ("ws",)).collect()} == {("w1", "new"), ("w2", "removed")}


def test_results_of_a_sync(spark):
    change = spark.createDataFrame([("a", "new"), ("b", "changed"), ("c", "new"), ("d", "changed"), ("e", "unchanged"), ("f", "removed"), ("g", "new")], "file_name string, change string")
    done = spark.createDataFrame([("a", "converted", None), ("b", "converted", None), ("c", "failed", "why"), ("d", "skipped", "empty")], "file_name string, outcome string, reason string")
    got = {r.file_name: (r.result, r.reason) for r in diff.sync_results(change, done).collect()}
    assert got == {"a": ("added", None), "b": ("changed", None), "c": ("failed", "why"), "d": ("skipped", "empty"), "e": ("unchanged", None), "f": ("removed", None), "g": ("failed", "the file was not converted")}


def test_order_is_by_code_point_within_its_scope(spark):
    rows = spark.createDataFrame([("w", "b"), ("w", "B"), ("w", "é"), ("w", "a10"), ("w", "a9"), ("x", "z")], "workspace_id string, file_name string")
    got = {(r.workspace_id, r.file_name): r.ord for r in diff.in_order(rows, ("workspace_id",)).collect()}
    assert got == {("w", "B"): 0, ("w", "a10"): 1, ("w", "a9"): 2, ("w", "b"): 3, ("w", "é"): 4, ("x", "z"): 0}
