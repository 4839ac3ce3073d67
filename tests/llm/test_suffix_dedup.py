import hashlib
import random

import numpy as np
import pytest

from lodestrata.llm import suffix_dedup as s

from .fixtures import corpus, frame


def plain(rows, length=100):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_arrays_are_sorted():
    rng = random.Random(0)
    for _ in range(400):
        t = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))]
        assert s.suffix_array(np.array(t, np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("crowded", [2048, 2])
def test_removal_is_that_of_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(s, "CROWDED", crowded)
    monkeypatch.setattr(s, "PART", 3000)
    rows = corpus(5, 70)
    got = {r.doc_id: tuple(r)[1:] for r in s.removal_report(frame(spark, rows)).collect()}
    assert got == plain(rows)


def test_repeated_rows_empty_table_and_short_lengths(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(300))
    rows = [(1, text), (1, text), (2, text), (3, "z" * 50 + text[:120])]
    got = sorted(tuple(r)[:4] for r in s.removal_report(frame(spark, rows)).collect())
    want = plain(rows[1:])
    assert got == sorted((i, *want[i][:3]) for i in (1, 1, 2, 3))
    assert s.removal_report(frame(spark, rows).where("doc_id > 9")).count() == 0


def test_large_ids_and_rows_without_one(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(n))
    passage, big = text(150), 2**60 + 1
    rows = [(None, "a" + passage), (big, passage + text(40)), (None, text(120)), (big + 1, text(30) + passage), (None, None)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in s.removal_report(frame(spark, rows)).collect()}
    size, n = len(passage.encode()), lambda k: len((rows[k][1] or "").encode())
    assert got == {(None, n(0)): size, (big, n(1)): 0, (None, n(2)): 0, (big + 1, n(3)): size, (None, 0): 0}
    assert sorted(str(r.doc_id) for r in s.without_repeats(frame(spark, rows)).collect()) == sorted(str(i) for i, _ in rows)


def test_runs_are_drawn_in_to_whole_characters(spark):
    from pyspark.sql import functions as F

    text = "aé€\U0001f600z" * 3
    raw = text.encode()
    cases = [(i, j) for i in range(len(raw) + 1) for j in range(i + 5, len(raw) + 1)]
    df = spark.createDataFrame([(text, [(i, j)]) for i, j in cases], "t string, runs array<struct<start:int,end:int>>")
    got = df.select(s._let(F.col("t").cast("binary"), lambda b: s._kept(b, s._whole_characters(b, F.col("runs")))).alias("k")).collect()
    for (i, j), r in zip(cases, got, strict=True):
        places = [(len(text[:k].encode()), c) for k, c in enumerate(text)]
        want = "".join(c for at, c in places if not (i <= at and at + len(c.encode()) <= j))
        assert bytes(r.k).decode() == want


def test_cut_texts_keep_whole_characters(spark):
    passage = "é" * 120 + "".join(chr(0x4E00 + i) for i in range(60))
    rows = [(1, passage + " one"), (2, "two " + passage), (3, None)]
    got = {r.doc_id: r for r in s.without_repeats(frame(spark, rows)).collect()}
    assert got[1].text != "" and got[3].text is None and got[2].component_id == 5
    assert got[2].text.startswith("two ") and len(got[2].text) < 30


def test_texts_that_share_a_doc_id_keep_what_is_their_own(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    first, own, passage = text(300), text(250), text(150)
    rows = [(1, first), (1, passage + text(20)), (2, first), (2, own), (2, passage + "..."), (3, "z"), (3, None)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in s.removal_report(frame(spark, rows)).collect()}
    assert got == {(1, 300): 0, (1, 170): 0, (2, 300): 300, (2, 250): 0, (2, 153): 150, (3, 1): 0, (3, 0): 0}
    cut = s.without_repeats(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns
    assert sorted((r.doc_id, r.text or "") for r in cut.collect()) == sorted([*((i, t or "") for i, t in rows[:2]), (2, ""), (2, own), (2, "..."), (3, "z"), (3, "")])
