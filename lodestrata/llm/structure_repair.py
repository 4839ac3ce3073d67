"""Cheapest repair of the turn structure of conversations.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Rows are blank (no character but blanks),
duplicate (their role and text came before) or truncated (the last character that is no blank ends no sentence); the first
that holds counts. Edits keep a row (K, 0), give it the role user or assistant (R, 1), delete it (D, 2; blank and duplicate
rows have to go) or insert a turn without text (I, 5); a truncated row that stays costs 5 more.

Edits are arcs between nodes (rows passed, state of the pattern). Least costs from the start and to the end, one pass over
the rows each way, tell which arcs lie on a cheapest path; from the start node on, the set of nodes reached so far follows
the least letter that any of their tight arcs has. That gives the least sequence in ASCII among the cheapest without listing
them, in time linear in the rows.

Rows are dealt and sorted by conversation, and each task reads its rows once, one conversation after the other: what it
holds of one are a few numbers and 16 bytes for a row; texts over ``SPOOL`` bytes wait in a file that goes with the
conversation. A conversation is edited as a whole, by one task.

A null role or text is one blank. Rows come by turn, nulls first, and by role and text where turns tie. Rows without a
conv_id are one conversation. A role that starts with none of s, u and a, or is empty, can't be kept. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, record_batch, table, tune

BLANKS, ENDS = " \t\n\v\f\r", ".!?"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Bytes of a conversation's roles and texts that are held in memory.
SPOOL = 8 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
STATES, NEVER = range(4), 1 << 60
#: The state after a row that is given a role, or inserted, and the role that it gets.
NEXT, GIVEN = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: The state after a row that is kept, by its role's initial; None: not there.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_NOWHERE = (None,) * 4


def _arcs(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that pass a row."""
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        more = CUT_SHORT if fault == TRUNCATED else 0
        kept = KEPT.get(initial, _NOWHERE)[state]
        if kept is not None:
            yield "K", more, kept
        yield "R", RENAME + more, NEXT[state]


def _arrived(cost: list[int]) -> list[int]:
    """Least costs from the start after inserts."""
    cost[USER] = min(cost[USER], min(cost[START], cost[SYSTEM], cost[ASSISTANT]) + INSERT)
    cost[ASSISTANT] = min(cost[ASSISTANT], cost[USER] + INSERT)
    return cost


def _left(cost: list[int]) -> list[int]:
    """Least costs to the end where inserts may come first."""
    cost[USER], cost[ASSISTANT] = min(cost[USER], cost[ASSISTANT] + INSERT), min(cost[ASSISTANT], cost[USER] + INSERT)
    cost[SYSTEM], cost[START] = min(cost[SYSTEM], cost[USER] + INSERT), min(cost[START], cost[USER] + INSERT)
    return cost


def cheapest(initials: list[str], faults: list[int] | bytes) -> tuple[int, str]:
    """The least cost, and the first in ASCII of the sequences of letters that have it."""
    n = len(initials)
    there, back = array("q", _arrived([0, NEVER, NEVER, NEVER])), array("q", bytes(32 * (n + 1)))
    for i in range(n):
        cost = [NEVER] * 4
        for state in STATES:
            now = there[4 * i + state]
            if now < NEVER:
                for _, price, to in _arcs(initials[i], faults[i], state):
                    cost[to] = min(cost[to], now + price)
        there.extend(_arrived(cost))
    back[4 * n :] = array("q", _left([0, NEVER, NEVER, 0]))
    for i in range(n - 1, -1, -1):
        after = back[4 * i + 4 : 4 * i + 8]
        back[4 * i : 4 * i + 4] = array("q", _left([min(price + after[to] for _, price, to in _arcs(initials[i], faults[i], state)) for state in STATES]))
    best, letters, frontier = back[START], [], {(0, START)}
    while not any(i == n and state in (START, ASSISTANT) and there[4 * i + state] == best for i, state in frontier):
        least, heads = "Z", set()
        for i, state in frontier:
            tight = [("I", INSERT, i, NEXT[state])]
            if i < n:
                tight += [(x, price, i + 1, to) for x, price, to in _arcs(initials[i], faults[i], state)]
            for letter, price, j, to in tight:
                if letter <= least and there[4 * i + state] + price + back[4 * j + to] == best:
                    if letter < least:
                        least, heads = letter, set()
                    heads.add((j, to))
        letters.append(least)
        frontier = heads
    return best, "".join(letters)


class Conversation:
    """The rows of one conversation as they come, and what is known of them."""

    def __init__(self, conv_id):
        self.conv_id, self.initials, self.faults = conv_id, [], bytearray()
        self.least = self.most = self.last_turn = None
        self.turns = self.illegal = 0
        self.seen: set[bytes] = set()
        self.rows = tempfile.SpooledTemporaryFile(max_size=SPOOL)  # noqa: SIM115  closed by done()

    def add(self, turn: int | None, role: str, text: str) -> None:
        r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        key = hashlib.sha256(b"%d:" % len(r) + r + t).digest()[:16]
        bare = text.rstrip(BLANKS)
        self.faults.append(BLANK if not bare else DUPLICATE if key in self.seen else TRUNCATED if bare[-1] not in ENDS else 0)
        self.seen.add(key)
        if self.initials and self.initials[-1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(role[:1])
        if turn is not None and turn != self.last_turn:  # turns come in order
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
            self.turns += 1
        self.rows.write(b"%d %d\n" % (len(r), len(t)) + r + t)

    def edited(self, audit: str) -> Iterator[tuple[str, bytes, bytes]]:
        """(letter, role, text) of what a sequence of edits leaves."""
        self.rows.seek(0)
        state, i = START, 0
        for letter in audit:
            role = text = b""
            if letter != "I":
                sizes = self.rows.readline().split()
                role, text = self.rows.read(int(sizes[0])), self.rows.read(int(sizes[1]))
                i += 1
            if letter == "D":
                continue
            if letter == "K":
                state = KEPT[self.initials[i - 1]][state]
            else:
                role, state = GIVEN[state].encode(), NEXT[state]
            yield letter, role, text

    def report(self) -> tuple:
        cost, audit = cheapest(self.initials, self.faults)
        sha = hashlib.sha256()
        for k, (_, role, text) in enumerate(self.edited(audit)):
            sha.update(b"\n" * bool(k) + role + b":")
            sha.update(text)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        counts = [self.faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)]
        return self.conv_id, gaps, *counts, self.illegal, cost, audit, sha.hexdigest()

    def turns_after(self) -> Iterator[tuple]:
        for k, (letter, role, text) in enumerate(self.edited(cheapest(self.initials, self.faults)[1])):
            yield self.conv_id, k, role.decode("utf-8", "surrogatepass"), text.decode("utf-8", "surrogatepass"), letter

    def done(self) -> None:
        self.rows.close()


def _conversations(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[Conversation]:
    """Conversations of rows (conv_id, turn, role, text, there) sorted by conv_id."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now
                    now.done()
                now = Conversation(conv_id)
            if there:
                now.add(turn, role, text)
    if now is not None:
        yield now
        now.done()


def _dealt(turns: DataFrame, there: str | None) -> DataFrame:
    tune(turns.sparkSession)
    whole = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    on = F.lit(True) if there is None else F.coalesce(F.col(there), F.lit(False))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), whole("role"), whole("text"), on.alias("there"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROWS = 1024


def reports(turns: DataFrame, there: str | None = None) -> DataFrame:
    """One row for each conv_id: gaps (turn numbers missing between the least and the most), rows by fault, illegal
    (neighbours whose initials aren't su, ua or au), cost, audit (the edits) and repaired_sha256 (of the rows ``role:text``
    that are left, joined by newlines). Rows where the column ``there`` isn't true only name their conversation."""

    def rows(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        done: list[tuple] = []
        for conversation in _conversations(batches):
            done.append(conversation.report())
            if len(done) == ROWS:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    def batch(done: list[tuple]) -> pyarrow.RecordBatch:
        ids, *counts, audits, shas = zip(*done, strict=True)
        numbers = {n: pyarrow.array(c, pyarrow.int64()) for n, c in zip(_REPORT, counts, strict=True)}
        return record_batch(conv_id=pyarrow.array(ids, pyarrow.int64()), **numbers, audit=pyarrow.array(audits, pyarrow.string()), repaired_sha256=list(shas))

    kinds = ", ".join(f"{n} long" for n in _REPORT)
    return _dealt(turns, there).mapInArrow(frugal(rows), f"conv_id long, {kinds}, audit string, repaired_sha256 string")


def repaired(turns: DataFrame, there: str | None = None) -> DataFrame:
    """The turns after the cheapest edits: conv_id, turn (from 0, gapless), role, text, edit (K, R or I)."""

    def rows(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        done, size = [], 0
        for conversation in _conversations(batches):
            for row in conversation.turns_after():
                done.append(row)
                size += len(row[3])
                if len(done) == ROWS or size > SPOOL:
                    yield batch(done)
                    done, size = [], 0
        if done:
            yield batch(done)

    def batch(done: list[tuple]) -> pyarrow.RecordBatch:
        ids, places, roles, texts, letters = zip(*done, strict=True)
        return record_batch(conv_id=pyarrow.array(ids, pyarrow.int64()), turn=pyarrow.array(places, pyarrow.int64()), role=list(roles), text=list(texts), edit=list(letters))

    return _dealt(turns, there).mapInArrow(frugal(rows), "conv_id long, turn long, role string, text string, edit string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows damaged by the CRC of ``conv_id:turn`` modulo 20. 0 takes the row away (it
    stays with ``there`` false), 1 its text, 2 its sentence ends, 3 puts it twice, 4 makes its role user."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn"))) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), whole("role").alias("role"), whole("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.col("kind") != 0, F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("there"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "there")


ORACLE_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), kinds AS (  -- CRC-32 of the name, bit by bit
  SELECT *, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda h, b: list_reduce(list_prepend(xor(h, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                                    lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS kind
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS copies(copy) WHERE copy <= CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM damaged
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two
  FROM placed
), back AS (  -- the cheapest way to the end from each state, rows from i on
  SELECT conv_id, max(i) + 1 AS i, {'c': 0, 'a': ''} AS z, {'c': 10, 'a': 'II'} AS s, {'c': 5, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS a
  FROM faulty GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_min([dz, {'c': u.c + 5, 'a': 'I' || u.a}]), list_min([ds, {'c': u.c + 5, 'a': 'I' || u.a}]), u, a
  FROM (
    SELECT conv_id, i, dz, ds, list_min([du, {'c': da.c + 5, 'a': 'I' || da.a}]) AS u, list_min([da, {'c': du.c + 5, 'a': 'I' || du.a}]) AS a
    FROM (
      SELECT f.conv_id, f.i,
        list_min([{'c': b.z.c + 2, 'a': 'D' || b.z.a}, CASE WHEN t < 9 THEN {'c': b.u.c + 1 + t, 'a': 'R' || b.u.a} END,
          CASE WHEN t < 9 AND initial = 's' THEN {'c': b.s.c + t, 'a': 'K' || b.s.a} WHEN t < 9 AND initial = 'u' THEN {'c': b.u.c + t, 'a': 'K' || b.u.a} END]) AS dz,
        list_min([{'c': b.s.c + 2, 'a': 'D' || b.s.a}, CASE WHEN t < 9 THEN {'c': b.u.c + 1 + t, 'a': 'R' || b.u.a} END,
          CASE WHEN t < 9 AND initial = 'u' THEN {'c': b.u.c + t, 'a': 'K' || b.u.a} END]) AS ds,
        list_min([{'c': b.u.c + 2, 'a': 'D' || b.u.a}, CASE WHEN t < 9 THEN {'c': b.a.c + 1 + t, 'a': 'R' || b.a.a} END,
          CASE WHEN t < 9 AND initial = 'a' THEN {'c': b.a.c + t, 'a': 'K' || b.a.a} END]) AS du,
        list_min([{'c': b.a.c + 2, 'a': 'D' || b.a.a}, CASE WHEN t < 9 THEN {'c': b.u.c + 1 + t, 'a': 'R' || b.u.a} END,
          CASE WHEN t < 9 AND initial = 'u' THEN {'c': b.u.c + t, 'a': 'K' || b.u.a} END]) AS da
      FROM back b JOIN (SELECT *, CASE fault WHEN 'none' THEN 0 WHEN 'truncated' THEN 5 ELSE 9 END AS t FROM faulty) f
        ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1))
), best AS (
  SELECT conv_id, CAST(z.c AS BIGINT) AS cost, z.a AS audit FROM back WHERE i = 1
), letters AS (
  SELECT conv_id, place, substr(audit, place, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS place FROM best)
), walked AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), left_ AS (
  SELECT w.conv_id, w.o, w.letter, f.role, CASE WHEN w.letter = 'I' THEN '' ELSE f.text END AS text,
         max(CASE WHEN w.o = 1 AND w.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS system
  FROM walked w LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE w.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS repaired
  FROM left_ GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
