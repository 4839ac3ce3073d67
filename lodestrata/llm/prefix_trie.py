"""The trie of turn prefixes of many conversations, with the totals of each subtree.

A conversation is a sequence of labels, one for each turn: 120 bits of MD5 of role and text, and the text's number of code
points. Conversations that are equal come together first: their ids are packed in ranges, and the ranges of one sequence are
hashed in order, as a stream. The distinct sequences are then sorted and dealt by range into shards. So a subtree lies in one
shard, or in neighbouring ones, and only nodes on the paths of a shard's first and last sequences can lie in several.

Each shard is a level-order trie in arrays: since its sequences are sorted, a level's nodes are where neighbours differ.
Degrees give the LOUDS bit vector (as many ones as children, and a zero, node by node), from which parents are read by rank
and select; one pass over the levels from the deepest up adds what each node has to its parent. Nodes of the two border
paths leave that pass out; they come out as parts, which an aggregation by prefix joins and one task adds up. That task gets
two paths a shard at most, however many conversations share them, and a node with many children meets them salted.

A shard holds about ``SHARD_TURNS`` turns of distinct sequences, whatever their first turns are. A conversation is one row.

A null role or text is empty. Turns come by number, nulls first, and where they tie by that hash.
Rows without a conv_id belong to no conversation. An empty table gives no rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, record_batch, scratch, stored, table, tune

SHARD_TURNS, SALTS = 1 << 16, 32
NOTHING = hashlib.sha256(b"").hexdigest()
ROOT = b"\0" * 16
_TURN = "array<struct<a:bigint,b:bigint,n:int>>"


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, block, seq: each conversation's turns in order, as (a, b, n): two hashes of role and text, and code points."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.md5(F.concat(F.char_length(whole("role")).cast("string"), F.lit(":"), whole("role"), whole("text")))
    hashes = [F.conv(F.substring(digest, start, 15), 16, 10).cast("long").alias(x) for start, x in ((1, "a"), (16, "b"))]
    turn = F.struct(F.col("turn"), *hashes, F.char_length(whole("text")).alias("n"))
    rows = turns.where("conv_id is not null").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("block"), turn.alias("t"))
    own = rows.repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", "block", F.transform("t", lambda t: F.struct(t["a"], t["b"], t["n"])).cast(_TURN).alias("seq"))


def with_shared_heads(own: DataFrame, most: int = 6) -> DataFrame:
    """conv_id, seq: the first h turns of the block's first conversation, where there is one, and then the own turns after
    the first h; h is the CRC of the conv_id modulo ``most``. A block holds under 200 ids, so its window is a small one."""
    base = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("seq", 1, most - 1))).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    placed = own.select("conv_id", "seq", h.alias("h"), F.coalesce(base, F.array().cast(_TURN)).alias("base"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return placed.select("conv_id", F.concat(F.slice("base", F.lit(1), F.col("h")), rest).alias("seq"))


def _packed(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
    """Rows (ka, kb, conv_id, seq), sorted -> a row for each run of one sequence: ka, kb, least, n, ids, seq."""
    for batch in batches:
        if batch.num_rows:
            ka, kb, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ka", "kb", "conv_id"))
            first = np.flatnonzero(np.r_[True, (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])])
            ends = np.r_[first[1:], len(ka)]
            ids = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(first, ends, strict=True)]
            yield record_batch(ka=ka[first], kb=kb[first], least=conv[first], n=ends - first, ids=ids, seq=batch.column("seq").take(pyarrow.array(first)))


def _joined(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
    """Runs sorted by sequence and least id -> a row for each sequence: seq, n, least, ends_sha256."""
    key, row, sha, done = None, None, None, []

    def batch() -> pyarrow.RecordBatch:
        return record_batch(seq=pyarrow.concat_arrays([d[0] for d in done]), n=[d[1] for d in done], least=[d[2] for d in done], ends_sha256=[d[3] for d in done])

    for runs in batches:
        columns = [runs.column(c).to_pylist() for c in ("ka", "kb", "least", "n", "ids")]
        for i, (a, b, least, n, ids) in enumerate(zip(*columns, strict=True)):
            if key == (a, b):
                row[1] += n
                sha.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*row, sha.hexdigest()))
            key, row, sha = (a, b), [runs.column("seq").slice(i, 1), n, least], hashlib.sha256(ids.encode())
            if len(done) == 1024:
                yield batch()
                done = []
    if key is not None:
        done.append((*row, sha.hexdigest()))
        yield batch()


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq) -> one row for each sequence: seq, n (conversations), least (conv_id), ends_sha256 (of their ids)."""
    keyed = conversations.select(*[F.xxhash64(F.lit(k), "seq").alias(x) for k, x in ((0, "ka"), (1, "kb"))], "conv_id", "seq")
    ranged = keyed.repartitionByRange("ka", "kb", "conv_id").sortWithinPartitions("ka", "kb", "conv_id")
    runs = ranged.mapInArrow(frugal(_packed), f"ka long, kb long, least long, n long, ids string, seq {_TURN}")
    met = runs.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "least")
    return met.mapInArrow(frugal(_joined), f"seq {_TURN}, n long, least long, ends_sha256 string")


@dataclass
class Trie:
    """A level-order trie. ``bits``: for each node a one for each child and a zero; labels and totals by node."""

    bits: np.ndarray
    label: np.ndarray
    depth: np.ndarray
    chars: np.ndarray
    end: np.ndarray
    border: np.ndarray

    @classmethod
    def of(cls, length: np.ndarray, label: np.ndarray, chars: np.ndarray) -> Trie:
        """The trie of sorted distinct sequences, given by their lengths and all their labels (two columns) and sizes.
        ``end`` has the node where each sequence ends; ``border`` marks the paths of the first and the last."""
        start = np.cumsum(length) - length
        at, live = np.zeros(len(length), np.int64), np.arange(len(length))
        levels, n = [(np.zeros(0, np.int64), np.zeros((1, 2), np.int64), np.zeros(1, np.int64))], 1
        borders = [np.zeros(1, np.int64)]
        for depth in range(1, int(length.max(initial=0)) + 1):
            live = live[length[live] >= depth]
            own, parent = label[start[live] + depth - 1], at[live]
            new = np.r_[True, (parent[1:] != parent[:-1]) | (own[1:] != own[:-1]).any(axis=1)]
            at[live] = n - 1 + np.cumsum(new)
            levels.append((parent[new], own[new], chars[start[live] + depth - 1][new]))
            n += int(new.sum())
            borders.append(at[[0, -1]])
        parents = np.concatenate([p for p, _, _ in levels])
        degree = np.bincount(parents, minlength=n)
        bits = np.ones(n + len(parents), bool)
        bits[np.cumsum(degree + 1) - 1] = False
        border = np.zeros(n, bool)
        border[np.concatenate(borders)] = True
        depth = np.repeat(np.arange(len(levels)), [len(c) for _, _, c in levels])
        return cls(bits, np.concatenate([x for _, x, _ in levels]), depth, np.concatenate([c for _, _, c in levels]), at, border)

    @property
    def parent(self) -> np.ndarray:
        """Of each node but the root: the zeros before its one are the nodes before its parent."""
        ones = np.flatnonzero(self.bits)
        return np.r_[0, ones - np.arange(len(ones))]

    @property
    def degree(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(np.r_[-1, zeros]) - 1

    def up(self) -> Iterator[slice]:
        """The nodes of each level but the root's, from the deepest."""
        edges = np.searchsorted(self.depth, np.arange(int(self.depth[-1]) + 2))
        for d in range(len(edges) - 2, 0, -1):
            yield slice(int(edges[d]), int(edges[d + 1]))


def _border_keys(trie: Trie, parent: np.ndarray) -> dict[int, bytes]:
    """A hash of the whole prefix for each node of the border paths."""
    keys = {0: ROOT}
    for node in np.flatnonzero(trie.border).tolist()[1:]:
        keys[node] = hashlib.blake2b(keys[int(parent[node])] + trie.label[node].astype("<i8").tobytes(), digest_size=16).digest()
    return keys


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _shard(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
    """Sorted sequences of one shard -> its nodes. ``key`` is set for nodes of the border paths, which have what lies below
    them without other border nodes, and ``parent_key`` for these and their children."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pyarrow.Table.from_batches(found)
    seq = rows["seq"].combine_chunks()
    turns = seq.flatten()
    length = pyarrow.compute.list_value_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b, chars = (turns.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "b", "n"))
    trie = Trie.of(length, np.stack([a, b], axis=1) if len(a) else np.zeros((0, 2), np.int64), chars)
    parent, degree, n = trie.parent, trie.degree, len(trie.depth)
    convs, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    convs[trie.end], least[trie.end] = rows["n"].to_numpy(), rows["least"].to_numpy()
    for level in trie.up():
        np.add.at(convs, parent[level], convs[level])
        np.minimum.at(least, parent[level], least[level])
    inner = ~trie.border
    leaves, saved = (inner & (degree == 0)).astype(np.int64), np.where(inner, (convs - 1) * trie.chars, 0)
    for level in trie.up():
        own = np.flatnonzero(inner[level]) + level.start
        np.add.at(leaves, parent[own], leaves[own])
        np.add.at(saved, parent[own], saved[own])
    children = np.bincount(parent[1:][inner[1:]], minlength=n)
    keys = _border_keys(trie, parent)
    sha = np.full(n, None, object)
    sha[inner] = NOTHING
    sha[trie.end] = rows["ends_sha256"].to_pylist()
    under = trie.border[parent]  # the parent is a border node
    for at in range(0, n, 1 << 14):
        part = range(at, min(n, at + (1 << 14)))
        cut = slice(part.start, part.stop)
        yield record_batch(
            conv_id=least[cut], depth=trie.depth[cut], parent_conv_id=pyarrow.array(least[parent[cut]], mask=under[cut]), n_convs=convs[cut], n_children=children[cut], n_leaves=leaves[cut], saved_tokens=saved[cut],
            ends_sha256=pyarrow.array(sha[cut].tolist(), pyarrow.string()), key=pyarrow.array([keys.get(i) for i in part], pyarrow.binary()), parent_key=pyarrow.array([keys.get(p) if i else None for i, p in zip(part, parent[cut].tolist(), strict=True)], pyarrow.binary()), chars=trie.chars[cut],
        )


def _upper(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
    """The border nodes of all shards, each once -> the same with their totals and their parents' conv_id."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pyarrow.Table.from_batches(found).sort_by("depth")
    at = {k: i for i, k in enumerate(rows["key"].to_pylist())}
    parent = np.array([at.get(k, 0) for k in rows["parent_key"].to_pylist()], np.int64)
    depth, conv, convs, children, leaves, saved, chars = (rows[c].to_numpy().copy() for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars"))
    np.add.at(children, parent[1:], 1)
    leaves[children == 0] += 1
    saved += (convs - 1) * chars
    edges = np.searchsorted(depth, np.arange(int(depth[-1]) + 2))
    for d in range(int(depth[-1]), 0, -1):
        level = slice(int(edges[d]), int(edges[d + 1]))
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    sha = [s or NOTHING for s in rows["ends_sha256"].to_pylist()]
    up = pyarrow.array(conv[parent], mask=depth == 0)
    for batch in pyarrow.table({"conv_id": conv, "depth": depth, "parent_conv_id": up, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "key": rows["key"]}).combine_chunks().to_batches(max_chunksize=1 << 14):
        yield batch


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, seq) -> one row for each distinct prefix: conv_id (its least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    tune(spark)
    with scratch(spark) as keep:
        distinct = stored(distinct_sequences(conversations), "sequences")
        turns = distinct.agg(F.sum(F.size("seq"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
        sorted_ = distinct.repartitionByRange(shards, "seq").sortWithinPartitions("seq")
        nodes = stored(sorted_.mapInArrow(frugal(_shard), f"{_NODE}, key binary, parent_key binary, chars long"), "nodes")
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        ones = [F.min(c).alias(c) for c in ("conv_id", "depth", "chars", "parent_key")]
        border = nodes.where("key is not null").groupBy("key").agg(*sums, *ones, F.max("ends_sha256").alias("ends_sha256"))
        upper = stored(border.repartition(1).mapInArrow(frugal(_upper), f"{_NODE}, key binary"), "upper")
        columns = [c.split()[0] for c in _NODE.split(", ")]
        inner = nodes.where("key is null")
        salted = inner.where("parent_key is not null").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
        heads = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        under = salted.join(heads, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("_up"))
        return keep(inner.where("parent_key is null").select(columns).unionByName(under.select(columns)).unionByName(upper.select(columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie_nodes(with_shared_heads(sequences(turns)))


ORACLE_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (  -- CRC-32 of the id, bit by bit
  SELECT conv_id, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda h, b: list_reduce(list_prepend(xor(h, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                                    lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), parts AS (
  SELECT i.conv_id, 0 AS part, o.p, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 100 AND o.p <= i.h
  UNION ALL
  SELECT i.conv_id, 1, o.p, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.p > i.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
         list(sha256(length(role) || ':' || role || text)) OVER w AS path
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
), prefixes AS (
  SELECT * FROM rebuilt UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM ids
), nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY path
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT * FROM prefixes QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY path
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)
), totals AS (
  SELECT path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted n JOIN totals t USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
