"""Sparse search by blocks: only blocks of chunks that can hold one of a query's best are read.

Chunks are numbered in each workspace and cut into blocks of ``BLOCK``. A row of the index holds the postings of one term in
a run of blocks, and beside them each block's greatest term frequency and least length. With these, a term's weight in a block has
an upper bound that holds for any corpus statistics: a frequency that is as great, in a chunk that is as short, can't weigh
less. So bounds need no renewal when a corpus grows.

A query goes three ways through the index. First the bounds alone are summed up by block. Then each query's ``PROBES``
blocks of the greatest bounds are scored; its k-th best score there is a score that its k best reach. Last, the blocks whose
bounds reach that score for some query are read, each once, and scored as in :mod:`nearest`; for the query all others are
skipped, since no chunk in them can be among the k best, ties included. Results are those of :func:`retrieve.bm25_top_k`. Bounds are compared with a slack for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.plans.storage import stored
from lodestrata.settings import Settings

from . import nearest, retrieve
from .order import placed

BLOCK, PROBES, SLACK = 128, 2, 1e-9
#: Bytes of terms that a task counts at once, but for what one more block, or chunk, may hold.
BYTES = 1 << 24
#: Bytes, as most of a list's blocks hold one chunk: arrays of so many numbers take several times as long to write.
LISTS = "term string, df bigint, heads binary, postings binary, names binary"
HEAD = np.dtype([("block", "<i8"), ("df", "<i4"), ("most_tf", "<i4"), ("least_length", "<i4")])
POSTING = np.dtype([("tf", "<i4"), ("length", "<i4"), ("name", "<i4")])  # name: the length of its id, -1 if that is null


@dataclass
class BlockIndex:
    """``lists``: workspace_id, term, df (all for a run of blocks), and as bytes ``heads``, a ``HEAD`` of each block, ``postings``,
    a ``POSTING`` of each chunk in these, and ``names``, the chunks' ids one after another; rows follow each other by workspace
    and term, in each file or in each run of blocks. ``sizes``: workspace_id, n, mean. Where lists hold postings that are void,
    ``dead`` (workspace_id, part, chunk_id) says which, by the lists' own column ``part``, and ``df`` (workspace_id, term, df)
    gives the frequencies, as numbers to sum up. Void postings only raise bounds, so results stay exact. ``kind``: the type of ids."""

    lists: DataFrame
    sizes: DataFrame
    df: DataFrame | None = None
    dead: DataFrame | None = None
    kind: str = "string"


def _block_rows(chunks: DataFrame, text: str, block: int) -> tuple[DataFrame, DataFrame]:
    tokens = chunks.select("workspace_id", "chunk_id", retrieve.words(F.col(text)).alias("t"))
    placed_ = numbered(tokens)
    sizes = placed_.groupBy("workspace_id").agg(F.count("*").alias("n"), F.avg(retrieve.n_words(F.col("t"))).alias("mean"), F.max("chunk_id").alias("last_id"))
    return block_rows(placed_, block), sizes


def numbered(tokens: DataFrame) -> DataFrame:
    """``tokens`` (workspace_id, chunk_id, t) with each chunk's ``_place`` in its workspace."""
    return placed(tokens, ("chunk_id",), ("workspace_id",), "_place")


def block_rows(chunks: DataFrame, block: int, first: int = 0) -> DataFrame:
    """The lists of numbered chunks, whose blocks count from ``first``. Chunks go to where their block is, once; all that follows stays there."""
    dealt = chunks.select("workspace_id", (F.floor(F.col("_place") / block) + F.lit(first)).alias("block"), "chunk_id", "t").repartition("workspace_id", "block")
    return in_blocks(dealt.sortWithinPartitions("workspace_id", "block", "chunk_id"))


def in_blocks(chunks: DataFrame) -> DataFrame:
    """The lists of ``chunks`` (workspace_id, block, chunk_id, t: as of :func:`retrieve.words`), of which those of a block follow each other in a part. Terms
    are counted in runs of whole blocks, by sorting numbers; a row is a term in a run, as most blocks hold a rare term once at
    most. Rows of a block that repeat a chunk_id and have as many terms add up."""
    schema = f"workspace_id {dict(chunks.dtypes)['workspace_id']}, {LISTS}"
    return chunks.select("workspace_id", F.col("block").cast("long").alias("block"), F.col("chunk_id").cast("string").alias("chunk_id"), "t").mapInArrow(lambda batches: map(_counted, _whole(batches)), schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(int)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)


def _terms(words: pa.ChunkedArray) -> pa.ListArray:
    words = words.combine_chunks()
    return pc.split_pattern(pc.if_else(pc.equal(words, ""), pa.scalar(None, pa.string()), words), " ")


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(columns[0]) else np.zeros(0, int)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, in tables of whole blocks."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        heads = _heads(_codes(rows["workspace_id"]), rows["block"].to_numpy())
        if not len(heads):
            continue
        for a, b in _cuts(rows, heads[:-1], heads[-1]):
            yield rows.slice(a, b - a)
        held = rows.slice(heads[-1])  # may go on in the next batch
    if held is not None:
        yield held


def _cuts(rows: pa.Table, heads: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows from one head to another, up to ``end``, of ``BYTES`` of terms and one run more at most."""
    if len(heads):
        bounds, before = np.append(heads, end), np.append(0, np.cumsum(pc.fill_null(pc.binary_length(rows["t"]), 0).to_numpy().astype(int)))
        for i, j in nearest.slices(np.diff(before[bounds]).cumsum(), BYTES):
            yield bounds[i], bounds[j]


def _sorted(lists: pa.Array, row: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The distinct pairs of a term and a ``row`` of the lists, in order of both: places in the terms, rows, how often, terms.
    With ``space`` the terms are in order too, and pairs in that of their rows' spaces first."""
    words, size = lists.flatten().dictionary_encode(), _sizes(lists)
    n, code, terms = max(len(lists), 1), words.indices.to_numpy(zero_copy_only=False).astype(int), words.dictionary
    if space is not None:
        order = pc.sort_indices(terms).to_numpy()
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        code, terms = place[code] + np.repeat(space * len(order), size), terms.take(pa.array(order))
    key = code * n + np.repeat(row, size)
    key.sort()
    heads = _heads(key)
    code, row = np.divmod(key[heads], n)
    return code % max(len(terms), 1), row, np.diff(np.append(heads, len(key))), terms


def _bytes(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """``data`` cut at ``ends``, which begin with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def _records(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for name, column in zip(kind.names, columns, strict=True):
        out[name] = column
    return out


def _read(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """How many bytes each value has, and all of them."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(ends), memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """The lists of whole blocks."""
    space, block, ids = (rows[c].combine_chunks() for c in ("workspace_id", "block", "chunk_id"))
    lists = _terms(rows["t"])
    length, spaces = _sizes(lists), _codes(rows["workspace_id"])
    heads = _heads(spaces, block.to_numpy())
    own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(rows))))
    name = np.stack([own, _codes(rows["chunk_id"]), length])
    order = np.lexsort(name[::-1])
    first = _heads(*name[:, order])
    row = np.empty(len(rows), int)  # of rows that repeat a chunk, the first
    row[order] = np.repeat(order[first], np.diff(np.append(first, len(rows))))
    term, row, tf, words = _sorted(lists, row, spaces)
    starts, size = _heads(term, own[row]), length[row]  # of what a term has in a block
    of = row[starts]
    tops = _heads(term[starts], spaces[of])
    most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(size, starts)) if len(starts) else (tf, size)
    tops = np.append(tops, len(starts))
    each = np.append(starts, len(row))[tops]  # where the postings of a row begin
    names = ids.take(pa.array(row))
    ends = np.frombuffer(names.buffers()[1], np.int32)[: len(names) + 1] if len(names) else np.zeros(1, np.int32)
    name = np.where(names.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), -1)
    heads, postings = _records(HEAD, block.to_numpy()[of], np.diff(np.append(starts, len(row))), most, least), _records(POSTING, tf, size, name)
    return pa.RecordBatch.from_pydict({
        "workspace_id": space.take(pa.array(of[tops[:-1]])), "term": words.take(pa.array(term[starts[tops[:-1]]])), "df": pa.array(np.diff(each), pa.int64()),
        "heads": _bytes(tops * HEAD.itemsize, pa.py_buffer(heads)), "postings": _bytes(each * POSTING.itemsize, pa.py_buffer(postings)), "names": _bytes(ends[each], names.buffers()[2] or pa.py_buffer(b"")),
    })


def _unpacked(lists: DataFrame, whole: bool, kind: str = "string") -> DataFrame:
    """A row for each block of ``lists``: what else they hold, block, most_tf, least_length; or (``whole``) for each posting:
    block, tf, length, chunk_id."""
    bytes_ = ("heads", "postings", "names")
    had = [c for c in lists.columns if c not in (*bytes_, "df")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, data = _read(batch["heads"])
            head, row = np.frombuffer(data, HEAD), np.repeat(np.arange(len(size)), size // HEAD.itemsize)
            if whole:
                posting, at = np.frombuffer(_read(batch["postings"])[1], POSTING), np.repeat(np.arange(len(head)), head["df"])
                row, ends = row[at], np.append(0, np.cumsum(np.maximum(posting["name"], 0)))
                names = _read(batch["names"])[1]
            for i in range(0, len(row), 1 << 18):
                j = min(len(row), i + (1 << 18))
                out = {c: batch[c].take(pa.array(row[i:j])) for c in had}
                if whole:
                    out |= {"block": pa.array(head["block"][at[i:j]]), **{c: pa.array(posting[c][i:j]) for c in ("tf", "length")}}
                    text = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer((ends[i : j + 1] - ends[i]).astype(np.int32)), pa.py_buffer(names[ends[i] : ends[j]])])
                    null = pa.array(posting["name"][i:j] < 0)
                    out["chunk_id"] = pc.if_else(null, pa.scalar(None, pa.string()), text) if null.true_count else text
                else:
                    out |= {c: pa.array(head[c][i:j]) for c in ("block", "most_tf", "least_length")}
                yield pa.RecordBatch.from_pydict(out)

    types = dict(lists.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in had) + (", block bigint, tf int, length int, chunk_id string" if whole else ", block bigint, most_tf int, least_length int")
    rows = lists.select(*had, *(bytes_ if whole else ["heads"])).mapInArrow(of, schema)
    return rows.withColumn("chunk_id", F.col("chunk_id").cast(kind)) if whole and kind != "string" else rows


def tallied(chunks: DataFrame) -> DataFrame:
    """workspace_id, term, df: numbers to sum up, of ``chunks`` (workspace_id, t)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for a, b in _cuts(whole, np.arange(len(whole)), len(whole)):
                rows = whole.slice(a, b - a).combine_chunks()
                spaces = _codes(rows["workspace_id"])
                term, row, _, words = _sorted(_terms(rows["t"]), np.arange(len(rows)), spaces)
                heads = _heads(term, spaces[row])
                yield pa.RecordBatch.from_pydict({"workspace_id": rows["workspace_id"].combine_chunks().take(pa.array(row[heads])), "term": words.take(pa.array(term[heads])), "df": pa.array(np.diff(np.append(heads, len(row))), pa.int64())})

    return chunks.select("workspace_id", "t").mapInArrow(of, f"workspace_id {dict(chunks.dtypes)['workspace_id']}, term string, df bigint")


def write_index(chunks: DataFrame, folder: str, text: str = "text", block: int = BLOCK) -> None:
    """Write the index of ``chunks`` (workspace_id, chunk_id, text) below ``folder``. A block is in one file, and files are
    sorted, so that the ranges of workspace and term in their row groups and pages say which of them a query needs."""
    rows, sizes = _block_rows(chunks, text, block)
    rows.sortWithinPartitions("workspace_id", "term").write.parquet(f"{folder}/lists")
    sizes.write.parquet(f"{folder}/sizes")


def read_index(spark: SparkSession, folder: str) -> BlockIndex:
    sizes = spark.read.parquet(f"{folder}/sizes")
    return BlockIndex(spark.read.parquet(f"{folder}/lists"), sizes.drop("last_id"), kind=dict(sizes.dtypes)["last_id"])


def _weight(idf: Column, tf: Column, length: Column, mean: Column, settings: Settings) -> Column:
    k1, b = settings.bm25_k1, settings.bm25_b
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


@dataclass
class Found:
    """``hits`` (query_id, chunk_id, score, rank) and, for each query that met any block, ``work``: blocks that hold a term
    of it, and how many of these were probed, read after that, and skipped."""

    hits: DataFrame
    work: DataFrame


def top_k(queries: DataFrame, index: BlockIndex, k: int, settings: Settings = Settings(), probes: int = PROBES) -> Found:
    """``queries`` (query_id, workspace_id, text) against an index."""
    asked = queries.select("query_id", "workspace_id", F.explode(F.array_distinct(retrieve.terms(F.col("text")))).alias("term"))
    wanted = asked.select("workspace_id", "term").distinct()
    small = F.broadcast if asked.limit(retrieve.FEW_TERMS + 1).count() <= retrieve.FEW_TERMS else lambda df: df
    rows = index.lists
    bounds_of_terms = wanted.agg(F.min("term"), F.max("term")).first()
    if bounds_of_terms[0] is not None:  # prunes files and row groups
        rows = rows.where(F.col("term").between(*bounds_of_terms))
    rows = rows.join(small(wanted), ["workspace_id", "term"], "left_semi")
    heads = stored(_unpacked(rows.select("workspace_id", "term", "heads"), False), "heads")  # without postings
    frequencies = rows if index.df is None else index.df.join(small(wanted), ["workspace_id", "term"], "left_semi")
    idf = frequencies.groupBy("workspace_id", "term").agg(F.sum("df").alias("df")).where("df > 0").join(index.sizes, "workspace_id")
    idf = stored(idf.select("workspace_id", "term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    weighed = stored(asked.join(idf, ["workspace_id", "term"]), "asked")  # terms that are there, with their statistics
    bound = _weight(F.col("idf"), F.col("most_tf"), F.col("least_length"), F.col("mean"), settings)
    # dealt by block first: what a block's terms add up to for each query then needs no shuffle
    bounds = heads.repartition("workspace_id", "block").join(small(weighed), ["workspace_id", "term"]).groupBy("query_id", "workspace_id", "block").agg(F.sum(bound).alias("bound"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = stored(bounds.withColumn("_r", F.row_number().over(by_bound)), "bounds")

    def postings(some: DataFrame, key: list[str]) -> DataFrame:
        """workspace_id, block, term, chunk_id, w: what lives in the blocks ``some``."""
        each = _unpacked(rows, True, index.kind).join(some, key, "left_semi")
        if index.dead is not None:
            each = each.join(index.dead, ["workspace_id", "part", "chunk_id"], "left_anti")
        weight = _weight(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean"), settings)
        return each.join(small(idf), ["workspace_id", "term"]).select("workspace_id", "block", "term", "chunk_id", weight.alias("w"))

    def probed(some: DataFrame) -> DataFrame:
        """Scores of all chunks of the blocks ``some`` (query_id, workspace_id, block), a few for each query."""
        terms, on = some.join(weighed.select("query_id", "workspace_id", "term"), ["query_id", "workspace_id"]), ["workspace_id", "block", "term"]
        met = postings(small(terms.select(*on).distinct()), on).join(small(terms), on)
        return met.groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))

    best = lambda hits: retrieve.top(hits, k, F.round("score", 9), "chunk_id")
    key = ["query_id", "workspace_id", "block"]
    first = stored(best(probed(bounds.where(F.col("_r") <= probes).select(*key))).drop("rank"), "probed")
    floor = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    rest = bounds.where(F.col("_r") > probes).join(floor, "query_id", "left")
    reaches = (F.coalesce("_n", F.lit(0)) < k) | (F.col("bound") * (1 + SLACK) + SLACK >= F.round("_least", 9))
    marked = stored(rest.select(*key, reaches.alias("reaches")), "rest")
    # a block that some query needs is read once, for all queries of its workspace: that adds scores, which are right too
    need = bounds.where(F.col("_r") <= probes).select(*key).unionByName(marked.where("reaches").select(*key)).select("workspace_id", "block").distinct()
    need = stored(need, "need")  # few and small, so that postings aren't shuffled to be met by them
    lists = weighed.groupBy("query_id", "workspace_id").agg(F.collect_list("term").alias("terms"))
    hits = best(nearest.sparse(lists, postings(need, ["workspace_id", "block"]), k, lists.count(), index.sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    counts = bounds.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("_r") <= probes).alias("probed"))
    later = marked.groupBy("query_id").agg(F.count_if("reaches").alias("read"))
    work = counts.join(later, "query_id", "left").withColumn("read", F.coalesce("read", F.lit(0)))
    return Found(hits, work.withColumn("skipped", F.col("blocks") - F.col("probed") - F.col("read")))
