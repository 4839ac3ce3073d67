import math
import random

import pytest

from lodestrata.operators import sessions

TURNS = "session_id string, turn long, role string, text string"


def plain(turns, resets, n):
    out = []
    for s, t, role, text in turns:
        key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
        mine = sorted([x for x in turns if x[0] == s], key=key)
        at = mine.index((s, t, role, text))
        since = max([r for q, r in resets if q == s and t is not None and r <= t], default=None)
        before = [x for x in mine[:at] if since is None or (x[1] is not None and x[1] >= since)] if s is not None else []
        out.append((s, t, role, text, [tuple(x[1:]) for x in before[-n:]]))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [4, 1024])
def test_memory_ends_at_the_last_reset(spark, monkeypatch, run):
    monkeypatch.setattr(sessions, "RUN", run)
    rng = random.Random(2)
    turns = [(f"s{s}", t, rng.choice(["user", "assistant", None]), rng.choice([f"t{s}.{t}", None])) for s in range(12) for t in range(rng.randint(1, 30))]
    turns += [("hot", t, "user", str(t)) for t in range(400)] + [(None, t, "user", f"lost {t}") for t in range(3)] + [("s1", None, "user", "no place")]
    resets = [(f"s{s}", t) for s in range(12) for t in range(30) if rng.random() < 0.15] + [("hot", 7), ("hot", 200), ("none", 1), ("s3", 2), ("s3", 2)]
    got = sessions.with_memory(spark.createDataFrame(turns, TURNS), spark.createDataFrame(resets, "session_id string, turn long"), 3)
    assert sorted(((*r[:4], [tuple(m) for m in r.memory]) for r in got.collect()), key=str) == plain(turns, resets, 3)


def test_a_follow_up_is_searched_with_what_it_refers_to(spark):
    turns = spark.createDataFrame([("s", 0, "user", "trial periods?"), ("s", 1, "assistant", "Three months."), ("s", 2, "user", "and renewals?"), ("t", 0, "user", "and renewals?")], TURNS)
    none = spark.createDataFrame([], "session_id string, turn long")
    seen = sessions.in_context(sessions.with_memory(turns, none, 4))
    assert {(r.session_id, r.turn): r.search for r in seen.collect()} == {("s", 0): "trial periods?", ("s", 2): "trial periods?\nand renewals?", ("t", 0): "and renewals?"}


def test_one_question_back_and_the_answer(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "a", 0.5, 2), (1, "b", 0.88, 3), (2, "a", 0.9, 1), (2, "b", 0.3, 2), (3, "c", 0.2, 1)], "query_id int, parent_id string, score double, rank int")
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id int")
    measured = {r.query_id: r for r in sessions.ambiguity(hits).collect()}
    assert math.isclose(measured[1].margin, 0.02 / 0.9) and measured[1].options == ["a", "b"] and (measured[3].margin, measured[3].entropy) == (1.0, 0.0)
    p = 0.75
    assert math.isclose(measured[2].entropy, -(p * math.log(p) + (1 - p) * math.log(1 - p)) / math.log(2))
    on, wait = sessions.questions_back(queries, hits, 0.1)
    assert sorted(r.query_id for r in on.collect()) == [2, 3, 4] and [(r.query_id, r.options) for r in wait.collect()] == [(1, ["a", "b"])]
    reply = lambda x: [(r.parent_id, r["rank"]) for r in sessions.resumed(wait, spark.createDataFrame([(1, x)], "query_id int, parent_id string"), hits).orderBy("rank").collect()]
    assert reply("b") == [("b", 1)] and reply("other") == [("a", 1), ("a", 2), ("b", 3)]
    on, wait = sessions.questions_back(queries, hits, 0.1, asked=queries)
    assert on.count() == 4 and wait.count() == 0
