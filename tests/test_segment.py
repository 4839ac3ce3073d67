"""Segmentation against a plain statement of its rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.ids import PARENT_NAMESPACE
from lodestrata.operators import segment
from lodestrata.settings import InvalidSettings, Settings


def plain_sections(text):
    out, label, body, fenced = [], None, [], False
    for line in text.splitlines():
        m = None if fenced else re.match(r"^(#{1,3})\s+(.*\S)\s*$", line)
        if m:
            out.append((label, body))
            label, body = m[2], []
        else:
            body.append(line)
            if re.match(r"\s*(```|~~~)", line):
                fenced = not fenced
    out.append((label, body))
    return [(a, t) for a, b in out if (t := "\n".join(b).strip())]


def plain_merge(secs, below):
    groups, now = [], []
    for s in secs:
        now.append(s)
        if sum(len(t) for _, t in now) >= below:
            groups.append(now)
            now = []
    if now and groups:
        groups[-1] = groups[-1] + now
    elif now:
        groups.append(now)
    out = []
    for g in groups:
        names = [a for a, _ in g if a]
        label = None if not names else names[0] if names[0] == names[-1] else f"{names[0]} ... {names[-1]}"
        out.append((label, "\n\n".join(t for _, t in g)))
    return out


def plain_pack(text, limit):
    if len(text) <= limit:
        return [text]
    out, held = [], ""
    for p in text.split("\n\n"):
        both = p if not held else held + "\n\n" + p
        if len(both) <= limit:
            held = both
        else:
            if held:
                out.append(held)
            k = max(0, (len(p) - 1) // limit)
            out += [p[i * limit : (i + 1) * limit] for i in range(k)]
            held = p[k * limit :]
    return out + ([held] if held else [])


def plain_windows(text, size, overlap):
    out, at = [], 0
    while text:
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += size - overlap
    return out


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["# One", "## Two  ", "### Trois", "#### four", "#tag", "``` py", "~~~", "  ```", "word", "été", "", "", " ", "x" * 30, "\U0001f600 end", "a\x0cb", "##\xa0Titre", " # no"]
    ends = ["\n", "\n", "\n", "\r\n", "\x85", "\u2028"]
    return ["".join(rng.choice(bits) + rng.choice(ends) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_sections_and_merging_follow_the_rules(spark):
    data = texts(1, 400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string").withColumn("s", segment.sections(F.col("t")))
    for below in (0, 7, 40):
        for row in df.withColumn("m", segment.merged(F.col("s"), below)).collect():
            want = plain_sections(data[row.i])
            assert [(s.label, s.text) for s in row.s] == want
            assert [(s.label, s.text) for s in row.m] == plain_merge(want, below)


def test_packing_and_windows_follow_the_rules(spark):
    rng = random.Random(2)
    data = ["".join(rng.choice(["a", "b\U0001f600", "\n\n", "\n", " ", "ccccccc"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string")
    for limit in (1, 5, 17):
        for row in df.select("i", segment.packed(F.col("t"), limit).alias("p")).collect():
            assert row.p == plain_pack(data[row.i], limit)
    for size, overlap in ((5, 2), (1, 0), (10, 9)):
        for row in df.select("i", segment.windows(F.col("t"), size, overlap).alias("w")).collect():
            assert row.w == plain_windows(data[row.i], size, overlap)


@pytest.mark.parametrize("n,count", [(1, 1), (499, 1), (500, 1), (501, 2), (900, 2), (901, 3)])
def test_window_boundaries(spark, n, count):
    df = spark.range(1).select(segment.windows(F.lit("x" * n), 500, 100).alias("w"))
    assert len(df.first().w) == count


def test_merge_ignores_separators_and_split_counts_them(spark):
    secs = spark.createDataFrame([([("a", "x" * 1999), ("b", "y" * 1999)],)], "s array<struct<label:string,text:string>>")
    row = secs.select(segment.merged(F.col("s"), 2000).alias("m")).first().m
    assert [(r.label, len(r.text)) for r in row] == [("a ... b", 4000)]
    assert len(spark.range(1).select(segment.packed(F.lit(row[0].text), 4000).alias("p")).first().p) == 1
    assert len(spark.range(1).select(segment.packed(F.lit(row[0].text + "z"), 4000).alias("p")).first().p) == 2


def test_chunk_gives_stable_ids_and_rebuilds_parents(spark):
    import uuid

    docs = spark.createDataFrame([("w", "a.md", "# A\n" + "line of text\n\n" * 500), ("w", "b.md", "   \n"), ("w", "c.md", None)], "workspace_id string, source_file string, markdown string")
    settings = Settings(child_size=50, child_overlap=10, merge_below=20, split_above=90)
    parents, children = segment.chunk(docs, settings)
    rows = {r.parent_id: r for r in parents.collect()}
    assert {r.source_file for r in rows.values()} == {"a.md"}
    for r in rows.values():
        assert r.parent_id == str(uuid.uuid5(PARENT_NAMESPACE, f"a.md\0{r.parent_index}"))
        assert r.section_label == "A" and r.workspace_id == "w"
    rebuilt = {}
    for c in sorted(children.collect(), key=lambda c: c.child_index):
        rebuilt[c.parent_id] = rebuilt.get(c.parent_id, "")[: c.child_index * 40] + c.text
    assert rebuilt == {k: r.text for k, r in rows.items()}


@pytest.mark.parametrize("bad", [{"child_size": 0}, {"child_overlap": -1}, {"child_overlap": 500}, {"split_above": 0}])
def test_settings_that_make_no_sense(bad):
    with pytest.raises(InvalidSettings):
        Settings(**bad).checked()


def test_plain_texts_are_cut_as_by_lines(spark):
    rng = random.Random(5)
    parts = ["#", "##", "####", " ", "\t", "\n", "\n\n", "\n# ", "\n## b", "a", " ", "　", "b c", "\n#\n", "\n### \n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_line = F.filter(segment._cut_lines(F.split("t", "\n")), lambda x: x["text"] != "")
    odd = df.select("t", segment.sections(F.col("t")).alias("a"), by_line.alias("b")).where("a <> b").collect()
    assert not odd


def test_fences_fold_over_marks_alone(spark):
    text = "# a\nx\n```\n# in\ny\n~~~\n# b\nz\n```\n# lost\nw"  # the third fence never closes
    got = spark.createDataFrame([(text,)], "t string").select(segment.sections(F.col("t")).alias("s")).first()["s"]
    assert [(r.label, r.text) for r in got] == [("a", "x\n```\n# in\ny\n~~~"), ("b", "z\n```\n# lost\nw")]


@pytest.mark.parametrize(("lengths", "groups"), [([], []), ([5], [1]), ([10, 10], [1, 1]), ([4, 6, 3], [3]), ([4, 6, 9, 1, 2], [2, 3]), ([1, 2], [2])])
def test_groups_of_sections(spark, lengths, groups):
    rows = [(f"l{i}", "x" * n) for i, n in enumerate(lengths)]
    got = spark.createDataFrame([(rows,)], "s array<struct<label:string,text:string>>").select(segment.merged(F.col("s"), 10).alias("m")).first()["m"]
    assert [len(r.text.split("\n\n")) for r in got] == groups
