"""Byte-level BPE encoding and decoding by a rank file.

A batch of texts is split into pre-tokens with array operations over code points, equal pre-tokens are encoded once, and
the ids are gathered back in text order. A pre-token that is no token itself goes through a queue of merges: each rank has a
bucket of positions in a linked list of parts, a bitmap of two levels finds the lowest rank that has any, and entries
whose pair has changed since are skipped. The lowest rank goes first and the leftmost pair of it, so that ids equal those
of the usual loop over all pairs, while a pre-token of n bytes costs n log n steps instead of n squared.

Nothing is shuffled: each row is encoded where it is read. Long texts are cut before white space that follows something
else, where a pre-token always starts, so that what a task holds at once is ``SLAB`` bytes or the longest pre-token.

A null text is an empty one and has no ids. Invalid UTF-8 is read with replacement characters. Rows are kept one for one:
rows that repeat a doc_id or have none are encoded each for itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import BASE, frugal, powers, record_batch, table, tune, utf8

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of text worked on at once, and pre-tokens whose ids a worker remembers.
SLAB, REMEMBERED = 1 << 20, 1 << 20

OTHER, LETTER, NUMBER, WHITE, END = range(5)
_CUT = re.compile(rb"[!-~](?=[ \n])")


class Vocabulary:
    """Ranks of a file of lines ``base64(token) rank``."""

    def __init__(self, path: str):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.low: list[int] = [0] * (len(tokens) // 256 + 1)
        self.buckets: dict[int, int | list[int]] = {}
        self._known: dict[bytes, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token as a whole.

        A bucket is one position, or a heap of several. ``top`` has a bit for each word of ``low`` that isn't zero, and a
        word one for each of 256 ranks whose bucket has a position; the least set bit of both is the lowest rank. All are
        empty again at the end. (The queue is written out here: as calls it would take twice the time.)
        """
        rank_of, low, buckets, top, n = self.ranks.get, self.low, self.buckets, 0, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each place
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # rank of a part with the next one
        pair.append(None)
        fresh = [(rank, i) for i, rank in enumerate(pair) if rank is not None]
        while True:
            for rank, i in fresh:
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = i
                    word = rank >> 8
                    low[word] |= 1 << (rank & 255)
                    top |= 1 << word
                elif type(held) is int:
                    buckets[rank] = [held, i] if held < i else [i, held]
                else:
                    heapq.heappush(held, i)
            fresh = []
            while top:
                some = top & -top
                word = some.bit_length() - 1
                bits = low[word]
                bit = bits & -bits
                rank = word << 8 | bit.bit_length() - 1
                i = buckets[rank]
                if type(i) is int:
                    del buckets[rank]
                    low[word] = bits = bits ^ bit
                    if not bits:
                        top ^= some
                else:
                    held = i
                    i = heapq.heappop(held)
                    if len(held) == 1:
                        buckets[rank] = held[0]
                if pair[i] == rank:  # else stale
                    break
            else:
                break
            j = end[i]
            end[i] = k = end[j]
            pair[i] = pair[j] = None
            if k < n:
                before[k] = i
                new = pair[i] = rank_of(piece[i : end[k]])
                if new is not None:
                    fresh.append((new, i))
            if i:
                h = before[i]
                new = rank_of(piece[h:k])
                if new != pair[h]:
                    pair[h] = new
                    if new is not None:
                        fresh.append((new, h))
        out, i, ranks = [], 0, self.ranks
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def ids(self, piece: bytes) -> bytes:
        """The ids of a pre-token, in four bytes each."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        known = self._known.get(piece)
        if known is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            known = array("I", self.merged(piece)).tobytes()
            if len(piece) <= 64:
                self._known[piece] = known
        return known

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return self.bytes[_ranges(self.start[ids], self.length[ids])]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, as the pattern's ``\\p{L}``, ``\\p{N}`` and ``\\s`` have it."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for run in regex.finditer(pattern, everything):
            out[np.array([*map(ord, run[0])])] = kind
    return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after the other."""
    ends = np.cumsum(length)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = np.flatnonzero(length)
    if len(some):
        first, size = start[some], length[some]
        out[0] = first[0]
        out[np.cumsum(size)[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return np.cumsum(out)


def piece_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. ``kind`` is END at the last code point, which is no text, and after each text.

    White space before something else leaves its last character to that if it is a blank, and to itself otherwise. An
    apostrophe after no blank takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    blank, after = points == 32, np.r_[kind[1:], END]
    starts = np.r_[True, kind[1:] != kind[:-1]] | (kind == END)
    text = (kind == OTHER) | (kind == LETTER) | (kind == NUMBER)
    joined = np.r_[False, blank[:-1]] & text
    starts[joined] = False
    last = (kind == WHITE) & (after != WHITE) & (after != END)
    starts |= last
    marks = np.flatnonzero((points == 39) & starts & (after == LETTER))
    if len(marks):
        one = points[marks + 1]
        two = points[np.minimum(marks + 2, n - 1)]
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        taken = np.where(short, 1, np.where(long, 2, 0))
        own = marks[taken > 0]
        starts[own + 1] = False
        rest = own + 1 + taken[taken > 0]
        starts[rest] = True
    return starts & (kind != END)


def encoded(texts: list[bytes], vocab: Vocabulary) -> Iterator[np.ndarray]:
    """The ids of each text."""
    raw = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("\0".join([*raw, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return
    kind = classes()[points]
    ends = np.cumsum([len(t) + 1 for t in raw]) - 1
    kind[ends] = END
    first = np.flatnonzero(piece_starts(points, kind))
    size = np.ones(len(points), np.int64)
    for least in (0x80, 0x800, 0x10000):
        size += points >= least
    size[ends] = 0
    at = np.cumsum(size) - size
    data = np.frombuffer(b"".join(t.encode("utf-8", "surrogatepass") for t in raw), np.uint8)
    start = at[first]
    length = np.diff(np.r_[start, len(data)])
    pieces_of = np.diff(np.searchsorted(first, np.r_[0, ends]))
    # equal pre-tokens by a polynomial hash, compared byte by byte after that
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = (sums[start + length] - sums[start]) * down[start] * BASE + length.astype(np.uint64)
    _, chosen, group = np.unique(hashes, return_index=True, return_inverse=True)
    whole = data.tobytes()
    if np.array_equal(length, length[chosen][group]) and np.array_equal(data, data[_ranges(start[chosen][group], length)]):
        distinct = [whole[i : i + k] for i, k in zip(start[chosen].tolist(), length[chosen].tolist(), strict=True)]
    else:  # two pre-tokens of one hash
        every = [whole[i : i + k] for i, k in zip(start.tolist(), length.tolist(), strict=True)]
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(p, len(number)) for p in every], np.int64)
        distinct = list(number)
    found = [vocab.ids(p) for p in distinct]
    count = np.array([len(f) for f in found], np.int64) >> 2
    flat = np.frombuffer(b"".join(found), np.uint32)
    n_ids = count[group]
    ids = flat[_ranges((np.cumsum(count) - count)[group], n_ids)]
    edge = np.r_[0, np.cumsum(n_ids)][np.r_[0, np.cumsum(pieces_of)]]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield ids[a:b]


def cut(text: bytes, most: int = SLAB) -> Iterator[bytes]:
    """``text`` in parts of about ``most`` bytes, each but the first starting with the white space after something else."""
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def ids(text: bytes | None, vocab: Vocabulary) -> np.ndarray:
    """The ids of one whole text."""
    parts = list(encoded(list(cut(text or b"")), vocab))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode_decode(docs: DataFrame, ranks: str = RANKS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of the ids' bytes)."""
    tune(docs.sparkSession)

    def batch_of(done: list[tuple], names: pyarrow.Array) -> pyarrow.RecordBatch:
        counts, a, b = zip(*done, strict=True)
        return record_batch(**{id: names, "n_tokens": pyarrow.array(counts, pyarrow.int64()), "ids_sha256": list(a), "decoded_sha256": list(b)})

    def rows(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        vocab = vocabulary(ranks)
        for batch in batches:
            if batch.num_rows:
                # parts of texts, in order; slabs of them are encoded together
                parts = ((i, part) for i, whole in enumerate(utf8(batch.column(text))) for part in cut(whole))
                n, id_sha, text_sha = [0] * batch.num_rows, [hashlib.sha256() for _ in range(batch.num_rows)], [hashlib.sha256() for _ in range(batch.num_rows)]
                for slab in _slabs(parts):
                    for (i, _), got in zip(slab, encoded([p for _, p in slab], vocab), strict=True):
                        n[i] += len(got)
                        id_sha[i].update(got.astype("<u4").tobytes())
                        text_sha[i].update(vocab.decoded(got).tobytes())
                yield batch_of([(k, x.hexdigest(), y.hexdigest()) for k, x, y in zip(n, id_sha, text_sha, strict=True)], batch.column(id))

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(frugal(rows), f"`{id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slabs(parts: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    out, total = [], 0
    for part in parts:
        out.append(part)
        total += len(part[1])
        if total >= SLAB:
            yield out
            out, total = [], 0
    if out:
        yield out


def with_ids(docs: DataFrame, ranks: str = RANKS, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out`` (array<int>): the ids of each text. Other columns ride along."""
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]

    def rows(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        vocab = vocabulary(ranks)
        for batch in batches:
            if batch.num_rows:
                found = [ids(t, vocab).astype(np.int32) for t in utf8(batch.column(text))]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                arrays = pyarrow.ListArray.from_arrays(pyarrow.array(offsets), pyarrow.array(np.concatenate(found)))
                yield pyarrow.RecordBatch.from_arrays([*(batch.column(c) for c in kept), arrays], [*kept, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(frugal(rows), f"{fields}, `{out}` array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
