import re

import numpy as np
import pytest

from lodestrata.llm import hyperminhash as h
from lodestrata.llm.components import components

from .fixtures import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width, percent=80):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_components_are_those_of_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(h, "FEW_IDS", 0 if width == 2 else 1 << 20)
    rows = corpus(3, 80)
    assert {tuple(r) for r in h.near_duplicates(frame(spark, rows), width).collect()} == plain(rows, width)


def test_copies_of_a_base_that_are_not_near_each_other(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(100, " ".join(base))]
    for k in range(30):  # each is over 0.8 to the base, and under 0.8 to the others
        own = list(base)
        own[k * 6 : k * 6 + 12] = [f"k{k}x{i}" for i in range(12)]
        rows.append((200 + k, " ".join(own)))
    assert {tuple(r) for r in h.near_duplicates(frame(spark, rows), 2).collect()} == plain(rows, 2)


@pytest.mark.parametrize(("dense", "block"), [(16, 512), (16, 3), (0, 512), (0, 4)])
def test_links_that_no_leader_has_are_completed(spark, monkeypatch, dense, block):
    monkeypatch.setattr(h, "DENSE", dense)
    monkeypatch.setattr(h, "BLOCK", block)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(200)]
        for k in range(14):  # the first ones lie at 0.5 to 0.75 of each other; then each has a near copy
            own = list(base)
            own[k * 6 : k * 6 + 20 + k] = [f"g{group}k{k}x{i}" for i in range(20 + k)]
            rows.append((1000 * group + 10 * k, " ".join(own)))
            own[190] = "edited"
            rows.append((1000 * group + 10 * k + 1, " ".join(own)))
    assert {tuple(r) for r in h.near_duplicates(frame(spark, rows), 2).collect()} == plain(rows, 2)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d")]
    got = [tuple(r) for r in h.near_duplicates(frame(spark, rows[:3]), 2).collect()]
    assert sorted(got) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]
    got = {tuple(r) for r in h.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False)}
    assert h.near_duplicates(frame(spark, rows).where("doc_id > 9"), 2).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    same, a, b = (np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (4000, 500, 500))
    x, y = h.registers([np.unique(np.concatenate((same, e))) for e in (a, b)])
    assert abs(h.estimated(x[None], y[None])[0] - 4000 / 5000) < 0.12
    short = h.registers([same[:1], same[:1], same[::1500]])
    assert (short[0] == short[1]).all() and not (short[0] == short[2]).all()


def test_intersections_equal_sets():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    y = [*x[:3], *[np.unique(rng.integers(40, 90, 20).astype(np.uint64)) for _ in range(4)]]
    assert h.intersections(x, y).tolist() == [[len(set(a) & set(b)) for b in y] for a in x]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 600), (600, 500), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 600: 500} or got == {**{i: 0 for i in range(1, 101)}, 600: 500}


def test_each_text_of_a_doc_id_links_and_joins_what_it_links_with(spark):
    words = lambda x: [f"{x}{i}" for i in range(60)]
    near = lambda x: " ".join([*words(x)[:-1], "end"])
    rows = [(9, " ".join(words("a"))), (9, " ".join(words("b"))), (9, " ".join(words("c"))), (9, None), (3, near("a")), (12, near("b")), (20, near("c")), (30, "other words")]
    got = {tuple(r) for r in h.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {(9, 59, 3, False), (9, 0, 3, False), (3, 59, 3, True), (12, 59, 3, False), (20, 59, 3, False), (30, 1, 30, True)}


def test_rows_without_a_doc_id_and_large_ids(spark):
    words = lambda x: [f"{x}{i}" for i in range(60)]
    near = lambda x: " ".join([*words(x)[:-1], "end"])
    big = 2**60 + 1
    rows = [(None, " ".join(words("a"))), (None, near("a")), (None, "alone here"), (None, None), (big, " ".join(words("b"))), (None, near("b")), (big + 1, "something else")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in h.near_duplicates(frame(spark, rows), 2).collect())
    alone = [x for x in got if x[0] == "None" and x[2] == "None" and x[1] == 59]
    assert len(alone) == 2 and sorted(x[3] for x in alone) == [False, True]
    rest = [x for x in got if x not in alone]
    assert rest == sorted([("None", 1, "None", True), ("None", 0, "None", True), (str(big), 59, str(big), True), ("None", 59, str(big), False), (str(big + 1), 1, str(big + 1), True)])
    kept = h.deduplicated(frame(spark, rows + rows + [(big, "another text of it")]), 2)
    assert kept.columns == frame(spark, rows).columns
    texts = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert [x for x in texts if not x[1].startswith("a0 ")] == sorted([("None", "alone here"), ("None", ""), (str(big), " ".join(words("b"))), (str(big + 1), "something else"), (str(big), "another text of it")])
    assert sum(x[1].startswith("a0 ") for x in texts) == 1


def test_texts_of_an_id_link_in_either_order(spark):
    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    near = lambda x: words(x) + " end"
    rows = [(1, words("a")), (1, words("u")), (2, near("a")), (3, near("u"))]
    for order in (rows, [rows[1], rows[0], *rows[2:]]):
        got = {(r.doc_id, r.component_id) for r in h.near_duplicates(frame(spark, order), 2).collect()}
        assert got == {(1, 1), (2, 1), (3, 1)}


def test_long_words_that_polynomials_confuse_are_told_apart():
    a, b = "ab", "ba"
    for _ in range(11):
        a, b = a + b, b + a
    x, y = h.shingle_sets([a.encode(), b.encode()], 2)
    assert x.tolist() != y.tolist()
