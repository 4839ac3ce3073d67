"""Best-fit packing by exact-complement hashing.

Documents become token pieces in one Python pass (only documents over the capacity are cut). Packing needs nothing but
the number of pieces of each length, so the plan is made on the driver from a histogram of at most ``capacity`` rows,
whatever the corpus holds:

1. Longest first, each length opens sequences and asks the index of single lengths, then of pair sums, then of triple
   sums, for an exact complement of the gap it leaves; combinations are consumed as often as availability allows.
2. What has no exact complement goes best fit: longest first into the smallest gap that takes it.

Each step of the plan is a run "m sequences of this pattern" and uses up at least one length or gap, so the plan's size
depends on the capacity and not on the corpus. Pieces are then dealt to runs by their rank within their length. The
rank comes from (length, bucket) counts, prefix sums and a rank inside a bucket. A length has as many buckets as its
pieces need, so that a length which most pieces share is ranked by many tasks; the driver sees one count for each length
and for each ``ROWS`` pieces at most.

Null texts are empty; an empty text is the end token alone. Rows are packed one by one, so a doc_id that repeats gives
its pieces as often, and rows without a doc_id give theirs without one. Pieces equal in all they have change places
freely. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, record_batch, slabs, stored, table, tune

CAPACITY, END_ID = 4096, 1
#: Distinct words in each of the two generations that a task keeps. When the young one is full it becomes the old one, so
#: words that come up again stay and rare ones go. The first words of a process's first task are left to the next. All that
#: changes nothing but time.
CACHED_WORDS, FIRST_WORDS = 400_000, 100_000
#: Pieces of one length that a task ranks: so many at least and at most.
LEAST_ROWS, ROWS = 1024, 1 << 16


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words:
    """Word -> its ids as little-endian bytes. Words are independent: the tokenizer drops white space before merging.

    New words of a text are encoded in one call, and told apart by their places in it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are as many as cores already
        if path not in _LOADED:
            tokenizer = Tokenizer.from_file(path)
            ending = np.zeros(tokenizer.get_vocab_size(), bool)
            ending[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
            _LOADED[path] = tokenizer, ending
        self.tokenizer, self.ending = _LOADED[path]
        self.known, self.old = dict(_FIRST.get(path, ())), {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        if len(self.known) >= CACHED_WORDS:
            self.known, self.old = {}, self.known
        for w in new:
            if w in self.old:
                self.known[w] = self.old[w]
        if self.old:
            new = [w for w in new if w not in self.old]
        plain = [w for w in new if w.isalpha()]  # one piece each to the tokenizer: its last token says so
        parts = self.tokenizer.encode_batch_fast([" ".join(plain[i : i + 2000]) for i in range(0, len(plain), 2000)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(x.ids, "<u4") for x in parts]])
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) == len(plain):
            new = [w for w in new if not w.isalpha()]
            self._keep(plain, ids, ends)
        found = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        at = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
        self._keep(new, np.array(found.ids, "<u4"), np.searchsorted(at, np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)))

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(words, [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _SEPARATORS.search(t) else _even(t).split() for t in texts]
        every = set().union(*filter(None, split))
        while new := every.difference(self.known):
            self.learn(list(new))
        return [self.ids(t) if w is None else b"".join(map(self.known.__getitem__, w)) for t, w in zip(texts, split, strict=True)]


#: The tokenizer and which of its tokens end a word, by path: loading it again and again would leave memory behind.
_LOADED: dict[str, tuple] = {}
#: The words that the first task of the process met first, by tokenizer: common ones, which all later tasks meet too.
_FIRST: dict[str, dict[str, bytes]] = {}


def _even(text: str) -> str:
    """The text with fewer different words, where its ids stay the same: marks that stand alone are words of their own to
    the tokenizer, which lower-cases all but special tokens."""
    if _JOINED.search(text):
        return text
    try:
        text.encode("latin-1")  # in these characters lower case is one to one and needs no normal form
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace(".", " .").replace(",", " ,")


#: White space to str.split, but characters like any other to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Full stops and commas next to other marks, which the tokenizer may join them to, and what may be a special token.
_JOINED = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))|<\|")


@contextlib.contextmanager
def encoder(path: str):
    """texts -> their ids as little-endian unsigned 32-bit bytes, the same as encoding each whole text at once."""
    words = _Words(path)
    yield lambda texts: [ids for slab in slabs(texts, len) for ids in words.encode(slab)]
    if path not in _FIRST:
        _FIRST[path] = dict(itertools.islice(words.known.items(), FIRST_WORDS))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids: little-endian bytes) of each piece of each row of ``docs``."""
    end = np.array([end_id], "<u4").tobytes()
    tune(docs.sparkSession)

    def cut(batches):
        with encoder(path) as encode:
            for batch in batches:
                rows, pieces, starts, parts = [], [], [], []
                for row, ids in enumerate(encode([t or "" for t in batch["text"].to_pylist()])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(at // 4)
                        parts.append(ids[at : at + 4 * capacity])
                columns = {"doc_id": batch["doc_id"].take(pyarrow.array(rows, pyarrow.int32())), "piece": pyarrow.array(pieces, pyarrow.int32()), "start": pyarrow.array(starts, pyarrow.int64())}
                columns |= {"length": pyarrow.array([len(x) // 4 for x in parts], pyarrow.int64()), "ids_crc32": pyarrow.array(map(zlib.crc32, parts), pyarrow.int64())}
                yield record_batch(**columns, **({"ids": pyarrow.array(parts, pyarrow.binary())} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(cut), schema)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """[(m, lengths)]: m sequences that hold pieces of these lengths. Uses up all counts; no sequence is over capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit a sequence of {capacity}")
        left[length] = n
    runs: list[tuple[int, tuple[int, ...]]] = []

    def take(lengths: tuple[int, ...]) -> int:
        m = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            left[x] -= m
        if m:
            runs.append((m, lengths))
        return m

    def pair(gap: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """The pair sum with the longest member that fills ``gap`` while what is ``used`` stays set aside."""
        low = np.arange(1, gap // 2 + 1)
        free = left[: gap + 1].copy()
        for x in used:
            if x <= gap:
                free[x] -= 1
        good = low[(free[low] > 0) & (free[gap - low] > (low * 2 == gap))]
        return (int(gap - good[0]), int(good[0])) if len(good) else None

    def thirds(gap: int):
        """Lengths that a pair sum may complete to ``gap``, longest first. After a few tries the sums of all pairs are
        worked out as one set of bits, and only lengths whose complement is in it are tried."""
        free = (np.flatnonzero(left[1:gap] > 0)[::-1] + 1).tolist()
        yield from free[:8]
        bits = sum(1 << b for b in free)
        sums = 0
        for b in free:
            sums |= bits << b
        yield from (b for b in free[8:] if sums >> (gap - b) & 1)

    open_gaps: dict[tuple[int, ...], int] = defaultdict(int)
    take((capacity,))
    for a in range(capacity - 1, 0, -1):
        while left[a]:
            gap = capacity - a
            if left[gap] > (gap == a) and take((a, gap)):
                continue
            if (two := pair(gap, (a,))) and take((a, *two)):
                continue
            if not any(left[b] > (b == a) and (two := pair(gap - b, (a, b))) and take((a, b, *two)) for b in thirds(gap)):
                break
    # best fit: a sequence with room is a pattern whose count is how many there are
    gaps: list[int] = []
    by_gap: dict[int, list[tuple[int, ...]]] = defaultdict(list)

    def offer(pattern: tuple[int, ...], m: int) -> None:
        room = capacity - sum(pattern)
        if not open_gaps[pattern]:
            by_gap[room].append(pattern)
            if len(by_gap[room]) == 1:
                insort(gaps, room)
        open_gaps[pattern] += m

    for a in np.flatnonzero(left)[::-1]:
        a, n = int(a), int(left[a])
        while n:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                per = capacity // a
                if n >= per:
                    offer((a,) * per, n // per)
                    n %= per
                if n:
                    offer((a,) * n, 1)
                break
            room = gaps[at]
            pattern = by_gap[room][-1]
            m = min(n, open_gaps[pattern])
            open_gaps[pattern] -= m
            if not open_gaps[pattern]:
                by_gap[room].pop()
                if not by_gap[room]:
                    gaps.pop(at)
            offer((*pattern, a), m)
            n -= m
    return runs + [(m, pattern) for pattern, m in open_gaps.items() if m]


def _slots(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each run of ranks."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for m, lengths in runs:
        offset = 0
        for x in lengths:
            out[x].append((ranks[x], sequence, offset))
            ranks[x] += m
            offset += x
        sequence += m
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored rows with doc_id, piece, length) with sequence_id and offset."""
    spark = pieces.sparkSession
    totals = {int(k): int(n) for k, n in pieces.groupBy("length").count().collect()}  # capacity rows at most
    slots = _slots(plan_runs(totals, capacity))
    rows = max(LEAST_ROWS, min(ROWS, sum(totals.values()) // capacity))
    many = [(k, -(-n // rows)) for k, n in totals.items() if n > rows]
    spread = pieces.withColumn("_bucket", F.lit(0).cast("long"))
    if many:  # a row for a length at most
        split = F.broadcast(spark.createDataFrame(many, "length long, _buckets long"))
        spread = pieces.join(split, "length", "left").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("_buckets", F.lit(1)))).select(*pieces.columns, "_bucket")
    firsts = {k: np.zeros(1, np.int64) for k in totals}
    if many:
        counts: dict[int, np.ndarray] = {k: np.zeros(n, np.int64) for k, n in many}
        for k, bucket, n in spread.join(split, "length", "left_semi").groupBy("length", "_bucket").count().toLocalIterator():
            counts[k][bucket] = n
        firsts |= {k: np.cumsum(n) - n for k, n in counts.items()}
    held = spark.sparkContext.broadcast((slots, firsts))  # the plan, and a number for each bucket
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = spread.withColumn("_rank", F.row_number().over(order) - 1)
    names = pieces.columns

    def place(batches):
        slots, firsts = held.value
        for batch in batches:
            length, bucket, rank = (batch[c].to_numpy() for c in ("length", "_bucket", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            by_length = np.argsort(length, kind="stable")
            head = np.flatnonzero(np.diff(length[by_length], prepend=-1))
            for own in np.split(by_length, head[1:]):
                if len(own):
                    k = int(length[own[0]])
                    first, to, at = slots[k]
                    place = rank[own] + firsts[k][bucket[own]]
                    run = np.searchsorted(first, place, "right") - 1
                    sequence[own], offset[own] = to[run] + place - first[run], at[run]
            yield record_batch(**{c: batch[c] for c in names}, sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(frugal(place), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(docs, path or vocabulary_path(), capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves, for writing. A sequence is one capacity's worth of ids."""
    ids = token_pieces(docs, path or vocabulary_path(), capacity, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])

    def glue(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int64)]})

    both = ids.withColumnRenamed("doc_id", "_doc_id")
    found = packed.join(both, ["piece", "ids_crc32"]).where(F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    return found.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(glue, "sequence_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
