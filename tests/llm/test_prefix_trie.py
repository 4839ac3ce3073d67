import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from lodestrata.llm import prefix_trie as p

TURNS = "conv_id long, turn long, role string, text string, depth int, seq string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], TURNS)


def plain(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base, h = c - int(np.fmod(c, 100)), zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def below(path):
        leaves, saved = int(path not in kids), (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        for k in kids.get(path, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    sha = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(members[path]) if rebuilt[c] == path).encode()).hexdigest()
    return sorted(((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids.get(path, [])), *below(path), sha(path)) for path, m in members.items()), key=str)


def awkward():
    rng, rows = random.Random(4), []
    lines = ["hi", "what?", "é \U0001f600", "", None, "ok then"]
    for c in [*range(-205, 405, 3), *range(1000, 1101), 2**62, 2**62 + 9]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]) if rng.random() < 0.1 else t, ["user", "assistant", None][t % 2 if rng.random() < 0.95 else 2], rng.choice(lines[:2] if t < 3 else lines)))
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 5600) for t in range(4)]  # a large group of copies
    rows += [(c, t, "user", f"hot first turn" if t == 0 else f"{c} {t}") for c in range(6000, 6300) for t in range(3)]
    rows += [(7000, t, "user", f"long {t}") for t in range(500)] + [(7001, t, "user", f"long {t}") for t in range(500)]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "user", "hi"), (8000, 0, "user", "w " * 500_000), (9001, 0, "user", "x"), (9001, 1, "user", "x")]
    return rows


@pytest.mark.parametrize("shard_turns", [1 << 16, 40])
def test_nodes_and_sql_on_awkward_rows(spark, shard_turns):
    rows = awkward()
    rng = random.Random(9)
    mixed = rng.sample(rows, len(rows))
    df = frame(spark, mixed)
    got = sorted(map(tuple, p.trie_nodes(p.with_shared_heads(p.sequences(df)), shard_turns).collect()), key=str)
    want = plain(rows)
    assert len(got) == len(want) and got == want
    if shard_turns > 40:
        short = [r for r in rows if r[0] is None or not 7000 <= r[0] <= 7001]
        conversations = frame(spark, short).select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841  read by name
        names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
        assert sorted(duckdb.sql(f"SELECT {names} FROM ({p.ORACLE_SQL})").fetchall(), key=str) == plain(short)


def test_louds_parents_and_degrees():
    seqs = sorted([(1,), (1, 2), (1, 2, 3), (1, 5), (4, 2), (4, 2, 9), (7,)])
    label = np.array([[x, x] for s in seqs for x in s], np.int64)
    trie = p.Trie.of(np.array([len(s) for s in seqs]), label, label[:, 0])
    assert trie.parent.tolist() == [0, 0, 0, 0, 1, 1, 2, 4, 6] and trie.degree.tolist() == [3, 2, 1, 0, 1, 0, 1, 0, 0]
    assert trie.label[:, 0].tolist() == [0, 1, 4, 7, 2, 5, 2, 3, 9] and trie.end.tolist() == [1, 4, 7, 5, 6, 8, 3]
    assert np.flatnonzero(trie.border).tolist() == [0, 1, 3]


def test_only_turnless_conversations_are_a_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    got = p.trie_nodes(p.with_shared_heads(p.sequences(frame(spark, [(c, 0, "user", "gone")])))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table(spark):
    assert p.trie_nodes(p.with_shared_heads(p.sequences(frame(spark, [])))).count() == 0
