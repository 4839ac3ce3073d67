import random
import uuid

from pyspark.sql import functions as F

from lodestrata.functions import ids, text, vectors
from lodestrata.settings import Settings

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0         　"


def strings(n=500):
    rng = random.Random(0)
    return ["".join(rng.choice(SPACES + "ab#é\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_strip_and_lines_are_pythons(spark):
    data = strings()
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(data)], "i int, s string").select("i", text.strip("s").alias("t"), text.lines("s").alias("l")).collect()
    for r in rows:
        s = data[r.i]
        assert r.t == s.strip()
        assert (r.l[:-1] if r.l[-1] == "" else r.l) == s.splitlines()


def test_headings_and_fences(spark):
    cases = {"# a": "a", "## b  ": "b", "###\xa0c": "c", "#### d": "", "#e": "", " # f": "", "#  ": "", "# ": "", "# g h\t": "g h"}
    for line, label in cases.items():
        assert spark.range(1).select(text.heading(F.lit(line)).alias("h")).first().h == label
    for line, fence in {"```": True, "~~~ x": True, "  ``` py": True, "\xa0~~~": True, "x ```": False, "``": False}.items():
        assert spark.range(1).select(text.is_fence(F.lit(line)).alias("f")).first().f is fence


def test_file_types(spark):
    cases = {"a.txt": "txt", "a.tar.gz": "gz", "a.": "", "noext": "", "REPORT.PDF": "pdf", ".hid.md": "md", ".md": ""}
    for name, kind in cases.items():
        assert spark.range(1).select(text.file_type(F.lit(name)).alias("k")).first().k == kind


def test_name_uuids_are_pythons(spark):
    for name in ("", "a.md\0000", "é\U0001f600"):
        got = spark.range(1).select(ids.name_uuid(ids.PARENT_NAMESPACE, F.lit(name)).alias("u")).first().u
        assert got == str(uuid.uuid5(ids.PARENT_NAMESPACE, name))


def test_fingerprints_parse_or_are_null(spark):
    good = {"sha256:ab:0": ("ab", 0), "sha256:zz:12": ("zz", 12)}
    bad = ["", "sha256:ab", "sha256:ab:1:2", "md5:ab:1", "sha256::1", "sha256:ab:-1", "sha256:ab:x", "sha256:ab:", "sha256:ab:+5", "sha256:ab: 5", "sha256:ab:5\n", "sha256:ab:99999999999999999999"]
    rows = spark.createDataFrame([(s,) for s in [*good, *bad]] + [(None,)], "s string").select("s", ids.parse_fingerprint(F.col("s")).alias("p")).collect()
    assert {r.s: None if r.p is None else tuple(r.p) for r in rows} == {**good, **dict.fromkeys(bad), None: None}


def test_vectors(spark):
    r = spark.range(1).select(vectors.dot(F.expr("array(1, 2)"), F.expr("array(3, 4)")).alias("d"), vectors.unit(F.expr("array(3, 4)")).alias("u"), vectors.unit(F.expr("array(0, 0)")).alias("z"), vectors.cosine(F.expr("array(1, 0)"), F.expr("array(0, 2)")).alias("c")).first()
    assert (r.d, r.u, r.z, r.c) == (11.0, [0.6, 0.8], [0.0, 0.0], 0.0)


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("LODESTRATA_CHILD_SIZE", "7")
    monkeypatch.setenv("LODESTRATA_SUPPORTED_TYPES", "txt,md")
    s = Settings.from_environment()
    assert (s.child_size, s.child_overlap, s.supported_types) == (7, 100, ("txt", "md"))
    d = Settings()
    assert (d.child_size, d.child_overlap, d.merge_below, d.split_above, d.dense_width, d.top_k, d.retry_ceiling) == (500, 100, 2000, 4000, 768, 5, 2)
