import hashlib
import re

from pyspark.sql import functions as F

from lodestrata.llm import iblt

from .fixtures import corpus, frame

PART = re.compile(r"[^\n]{1,160}[^\n.!?]*[.!?]*")


def plain(rows):
    order = sorted(rows, key=lambda r: -r[0])
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        a, b, c = (set(PART.findall(x)) for x in (t, e, n))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(a, b), 9), round(alike(a, c), 9))
    return out


def test_edits_hashes_and_likeness(spark):
    rows = corpus(9, 60)
    got = iblt.fingerprints(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == plain(rows)
    texts, prints = {i: t or "" for i, t in rows}, {r.doc_id: r.fingerprint for r in got}
    for i in texts:
        for j in texts:
            if texts[i] == texts[j]:
                assert prints[i] == prints[j]


def test_one_row_repeated_rows_and_empty_table(spark):
    one = iblt.fingerprints(frame(spark, [(5, "abc def")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(5, "abcdef"), (5, "abcdef"), (4, None), (9, "x y z")]
    got = iblt.fingerprints(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [4, 5, 5, 9] and len({tuple(r) for r in got if r.doc_id == 5}) == 1
    assert iblt.fingerprints(frame(spark, rows).where("doc_id > 10")).count() == 0


def test_repeated_rows_are_like_single_ones(spark):
    for rows in ([(4, "zzz"), (5, "abcdef")], [(4, "a\nb\nq"), (5, "a\nb\nc")], [(4, "zzz"), (5, "a\nb"), (6, "b\nzzz")]):
        want = {r.doc_id: tuple(r) for r in iblt.fingerprints(frame(spark, rows)).collect()}
        for copies in (2, 3):
            got = iblt.fingerprints(frame(spark, rows + rows[1:2] * (copies - 1))).collect()
            assert len(got) == len(rows) + copies - 1 and all(tuple(r) == want[r.doc_id] for r in got)


def hashed(k, which):
    a, b, c = iblt._ODD[3 * which : 3 * which + 3]
    return ((k >> 24) * a + (k & 0xFFFFFF) * b + c) % iblt.PRIME


def parsed(text, groups):
    """The cells of a written fingerprint, its groups added up to so many."""
    out = {}
    for x in filter(None, text.partition("|")[2].split(" ")):
        g, cell, n, k, h = x.split(".")
        old = out.get((int(g) % groups, int(cell)), (0, 0, 0))
        out[int(g) % groups, int(cell)] = old[0] + int(n), old[1] ^ int(k, 16), old[2] ^ int(h, 16)
    return out


def peeled(a, b):
    """(digests of both, digests that differ) from two written fingerprints; None if peeling leaves a rest."""
    groups = min(int(x.partition("|")[0]) for x in (a, b))
    x, y = parsed(a, groups), parsed(b, groups)
    cells = {}
    for c in x.keys() | y.keys():
        p, q = x.get(c, (0, 0, 0)), y.get(c, (0, 0, 0))
        cells[c] = [p[0] - q[0], p[1] ^ q[1], p[2] ^ q[2]]
    found, todo = 0, list(cells)
    while todo:
        c = todo.pop()
        n, k, h = cells[c]
        if abs(n) == 1 and hashed(k, 0) & 0xFFFF == h:
            found += 1
            for j in range(3):
                at = (c[0], (hashed(k, j + 1) & 63) + 128 * j)
                cells[at] = [cells[at][0] - n, cells[at][1] ^ k, cells[at][2] ^ h]
                todo.append(at)
    if any(map(any, cells.values())):
        return None
    return sum(v[0] for z in (x, y) for (_, cell), v in z.items() if cell < 128), found


def test_likeness_is_that_of_the_written_fingerprints(spark):
    rows = corpus(9, 60)
    got = sorted(iblt.fingerprints(frame(spark, rows)).collect(), key=lambda r: -r.doc_id)
    tried = {"edited": 0, "next": 0}
    for k, r in enumerate(got):
        pairs = {"edited": (r.edited_fingerprint, r.near_edited), "next": (got[(k + 1) % len(got)].fingerprint, r.near_next)}
        for name, (other, near) in pairs.items():
            found = peeled(r.fingerprint, other)
            if found is not None:
                every, diff = found
                assert near == ((every - diff) / (every + diff) if every else 1.0)
                tried[name] += 1
    assert tried["edited"] > 0.9 * len(got) and tried["next"] > 0.9 * len(got)


def test_peeling_recovers_what_differs_or_says_that_it_cannot(spark):
    sets = [(list(range(20)), list(range(5, 22))), ([], [3]), ([7], []), (list(range(300)), []), (list(range(30)), list(range(100, 130))), (list(range(400)), list(range(200, 600)))]
    key = lambda x: int(hashlib.md5(str(x).encode()).hexdigest()[:12], 16)
    sets = [tuple([key(x) for x in side] for side in pair) for pair in sets]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sets)], "id int, mine array<bigint>, other array<bigint>")
    sides = df.select("id", F.posexplode(F.array("mine", "other")).alias("side", "digests"), F.lit(1).cast("bigint").alias("groups"), F.lit(0).alias("part"))
    for rung, size in enumerate(iblt.LADDER):
        found = iblt._cells(sides, ["id"], {0: rung}).select("id", iblt.peeled(iblt.subtracted(F.col("cells")), rung).alias("d"))
        for r in found.collect():
            a, b = map(set, sets[r.id])
            if r.d is not None:
                assert {(x.s, x.k) for x in r.d} == {(1, k) for k in a - b} | {(-1, k) for k in b - a} and len(r.d) == len(a ^ b)
            else:
                assert len(a ^ b) > size


def test_what_cannot_be_peeled_is_sketched_again_or_settled(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {i % 3} {k}" for k in range(40 + 13 * (i % 5)))) for i in range(12)]
    want = plain(rows)
    for ladder, hopeless in (((64, 64, 128), 80), ((64, 64, 128), 0), ((8, 16, 64), 10**6), ((1, 1, 64), 10**6), ((1, 1, 1), 10**6)):
        monkeypatch.setattr(iblt, "LADDER", ladder)
        monkeypatch.setattr(iblt, "HOPELESS", hopeless)
        got = iblt.fingerprints(frame(spark, rows)).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == want


def test_query_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duckdb.sql(iblt.ORACLE_SQL)
    got = iblt.query(spark, folder)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_rows_without_an_id_are_one_id_below_all_others(spark):
    rows = [(i, t) for i, t in corpus(2, 12)] + [(None, "no id\nat all"), (None, "nor here\nno id")]
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:])
    want = iblt.fingerprints(frame(spark, [(-1 if i is None else i, t) for i, t in rows])).collect()
    got = iblt.fingerprints(frame(spark, rows))
    assert dict(got.dtypes)["doc_id"] == "bigint" and sorted(map(key, got.collect())) == sorted(map(key, want))
    only = iblt.fingerprints(frame(spark, [(None, "no id")])).collect()
    assert [(r.doc_id, r.near_next) for r in only] == [(None, 1.0)]
