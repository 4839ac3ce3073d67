import datetime
import math
import random

from lodestrata.operators import feedback

ANSWERS = "answer_id string, workspace_id string, question string, up long, mark string, at string"


def at(k):
    return None if k is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)


def tables(spark, seed=0, n=400):
    rng = random.Random(seed)
    answers = [(f"a{i}", None if i % 9 == 4 else f"w{i % 3}", None if i == 5 else f"q{i}", 9, "x", "y") for i in range(30)]
    marks = [
        (
            "a0" if rng.random() < 0.4 else rng.choice([*(f"a{i}" for i in range(25)), "lost", None]), rng.choice(["u1", "u2", "u3", "u4", None]),
            rng.choice(["up", "down", "down", "none", "maybe", None]), rng.choice([None, "", "  ", "wrong", "née 😀", "x" * 4001]), at(rng.choice([None, *range(60)])),
        )
        for _ in range(n)
    ]
    marks += marks[:20]
    return answers, marks, spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(marks, feedback.SCHEMA)


def reason(mark, known):
    answer, user, kind, comment, _ = mark
    if answer not in known:
        return "no such answer"
    if user is None:
        return "no user"
    if kind not in ("up", "down", "none"):
        return "not a mark"
    return "comment too long" if comment and len(comment) > 4000 else None


def last(marks):
    out = {}
    low = datetime.datetime.min
    for a, u, kind, comment, t in marks:
        key = (t or low, kind, comment is not None, comment or "")
        if (a, u) not in out or key > out[a, u][0]:
            out[a, u] = (key, kind, comment, t)
    return {k: v[1:] for k, v in out.items() if v[1] in ("up", "down")}


def test_marks_are_checked_kept_and_read_again(spark, tmp_path):
    _, marks, answers, rows = tables(spark)
    known = {f"a{i}" for i in range(30)}
    folder = str(tmp_path / "marks")
    first, second = feedback.record(rows, answers, folder), feedback.record(rows, answers, folder)
    refused = [(*m, reason(m, known)) for m in marks if reason(m, known)]
    for got in (first, second):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(refused, key=str)
    kept = [m for m in marks if not reason(m, known)]
    back = feedback.recorded(spark, folder)
    assert back.count() == 2 * len(kept) and kept
    want = sorted(((a, u, *v) for (a, u), v in last(kept).items()), key=str)
    assert sorted(map(tuple, feedback.current(back).collect()), key=str) == want  # a batch that comes twice changes nothing


def test_review_and_rates_equal_plain_versions(spark):
    for seed in range(3):
        plain, marks, answers, rows = tables(spark, seed)
        kept = [m for m in marks if not reason(m, {a[0] for a in plain})]
        good = feedback.checked(rows, answers).where("reason is null")
        now = last(kept)
        want = [(w, a, q, u, comment, t) for a, w, q, *_ in plain for (b, u), (kind, comment, t) in now.items() if a == b and kind == "down" and comment and comment.strip(" ")]
        assert sorted(map(tuple, feedback.review(answers, good).collect()), key=str) == sorted(want, key=str) and want
        got = {r.workspace_id: r for r in feedback.rates(answers, good).collect()}
        assert set(got) == {a[1] for a in plain}
        for space, r in got.items():
            mine = [a[0] for a in plain if a[1] == space]
            kinds = [kind for (a, _), (kind, *_) in now.items() if a in mine]
            down, n = kinds.count("down"), len(kinds)
            assert (r.answers, r.marked, r.up, r.down) == (len(mine), len({a for a, _ in now if a in mine}), n - down, down)
            if not n:
                assert r.share_down is r.low is r.high is None
                continue
            p, z = down / n, 1.96
            root = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
            for have, side in ((r.low, -1), (r.high, 1)):
                assert math.isclose(have, (p + z * z / (2 * n) + side * root) / (1 + z * z / n), abs_tol=1e-12)
            assert r.low <= r.share_down <= r.high or math.isclose(p, 0, abs_tol=1e-9) or math.isclose(p, 1)


def test_empty_tables(spark):
    _, _, answers, rows = tables(spark)
    none, nobody = rows.limit(0), answers.limit(0)
    assert feedback.review(answers, none).count() == feedback.review(nobody, rows).count() == feedback.rates(nobody, rows).count() == feedback.checked(none, answers).count() == 0
    assert {r.marked for r in feedback.rates(answers, none).collect()} == {0}
    assert {r.reason for r in feedback.checked(rows, nobody).collect()} == {"no such answer"}
