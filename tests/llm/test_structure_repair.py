import hashlib
import random
import re
import zlib
from itertools import product

import duckdb

from lodestrata.llm import structure_repair as s

TURNS = "conv_id long, turn long, role string, text string, audit string, cost int"
SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()
GOOD = re.compile(r"(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)


def every_way(initials, faults, most_inserts=3):
    """(cost, audit) of the best of all edit sequences, by trying them."""
    found = []

    def go(i, cost, audit, out, inserts):
        if i == len(initials) and GOOD.fullmatch(out):
            found.append((cost, audit))
        if inserts < most_inserts:
            for x in "ua":
                go(i, cost + 5, audit + "I", out + x, inserts + 1)
        if i == len(initials):
            return
        more = 5 if faults[i] == 3 else 0
        go(i + 1, cost + 2, audit + "D", out, inserts)
        if faults[i] not in (1, 2):
            if initials[i] in ("s", "u", "a"):
                go(i + 1, cost + more, audit + "K", out + initials[i], inserts)
            for x in "ua":
                go(i + 1, cost + 1 + more, audit + "R", out + x, inserts)

    go(0, 0, "", "", 0)
    return min(found)


def test_the_cheapest_and_least_of_all_sequences():
    for n in range(4):
        for initials in product("suat", repeat=n):
            for faults in product((0, 1, 3), repeat=n):
                assert s.cheapest(list(initials), list(faults)) == every_way(initials, faults), (initials, faults)
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(4, 6)
        initials, faults = [rng.choice(["s", "u", "a", "", "x"]) for _ in range(n)], [rng.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        assert s.cheapest(initials, faults) == every_way(initials, faults, 2), (initials, faults)


def plain(rows):
    """The whole query in Python."""
    convs = {}
    for conv_id, turn, role, text in rows:
        kept = convs.setdefault(conv_id, [])
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv_id, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        cost, audit = s.cheapest(initials, faults)
        lines, left, state = [], list(kept), ""
        for letter in audit:
            row = left.pop(0) if letter != "I" else (None, "", "")
            if letter != "D":
                role = row[1] if letter == "K" else "assistant" if state.endswith("u") else "user"
                state += role[0]
                lines.append(f"{role}:{row[2]}")
        assert GOOD.fullmatch(state) and not left
        turns = {r[0] for r in kept} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv_id, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, SHA("\n".join(lines))))
    return sorted(out, key=str)


def awkward():
    rng, rows = random.Random(5), []
    for c in [*range(40), -7, 2**62, None]:
        for t in range(rng.choice([1, 2, 3, 6, 12])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Üser"])
            text = rng.choice(["Yes.", "no", "", " \t\r\v", None, "x\x1c", "Why?  \n", "é!", "a: b\nc.", " . ", "w" * 50])
            rows.append((c, rng.choice([t, t, t, None, t * 3, t - 5]), role, text))
    rows += [(50, 1, "user", "same."), (50, 1, "user", "same."), (51, None, None, None), (52, 0, "user", "long " * 400_000 + "."), (52, 1, "assistant", "Short.")]
    rows += [(60, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    return rows


def test_reports_and_sql_on_awkward_rows(spark):
    rows = awkward()
    df = frame(spark, rows)
    got = sorted(map(tuple, s.reports(s.damaged(df), "there").collect()), key=str)
    assert got == plain(rows)
    dropped = next(r[0] for r in got if r[7] == "" and r[2:5] == (0, 0, 0))  # a conversation of which no row was left
    assert next(r for r in got if r[0] == dropped)[8] == SHA("")
    conversations = df.select("conv_id", "turn", "role", "text").where("conv_id is null or conv_id <> 60").toArrow()  # noqa: F841  read by name
    want = duckdb.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({s.ORACLE_SQL})").fetchall()
    assert [g for g in got if g[0] != 60] == sorted(want, key=str)


def test_repaired_turns_are_the_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Bye."), (2, 0, "user", "")]
    got = sorted(map(tuple, s.repaired(frame(spark, rows)).collect()))
    assert got == [(1, 0, "system", "Be kind.", "K"), (1, 1, "user", "Hi.", "R"), (1, 2, "assistant", "Bye.", "R")]


def test_texts_over_the_spool_wait_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(s, "SPOOL", 64)
    one = s.Conversation(1)
    for t, (role, text) in enumerate([("user", "a\n" * 500 + "."), ("assistant", "é" * 300 + "!")]):
        one.add(t, role, text)
    assert one.report()[-1] == SHA("user:" + "a\n" * 500 + ".\nassistant:" + "é" * 300 + "!")
    one.done()


def test_empty_table(spark):
    df = frame(spark, [])
    assert s.reports(s.damaged(df), "there").count() == 0 and s.repaired(df).count() == 0
