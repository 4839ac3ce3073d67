"""Nearest neighbours by multi-index hashing.

Codes: vectors are lifted by one coordinate so that the largest inner product becomes the largest cosine, reduced to
their principal directions and rotated, twice, by rotations learned to put the coordinates near the corners of a cube
(iterative quantisation); signs give 2 x 64 bits. Fitting takes a bounded sample (``sample`` vectors, those with the
least hashed ids); every vector is indexed.

Index: the 128 bits are 16 substrings of 8 bits, each with its own lists of codes by value. Two codes within Hamming
radius R agree in some substring up to a few bits (pigeonhole: substring radii r_i with sum(r_i + 1) > R), so probing
the lists within those radii meets every code within R; full Hamming distances then keep exactly those, and their inner
products in double precision rank them. R is learned: the radius that holds ``keep`` of the true neighbours in the
sample. In a block where fewer than k codes lie within R the radius grows until there are k.

Vectors are dealt to blocks of about ``block`` by hash, queries likewise, and each pair of blocks is one task of bounded
memory; what it sends on is k rows a query. Copies of one vector, however many, are dealt over the blocks like others.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another length
than the sample's commonest, or rows without an id. Ties go to the smaller id. A row is never its own neighbour; rows that
repeat a query's id count as the query, whose vector is the least of theirs, and rows that repeat a candidate's id are one
candidate, at its best score. With no vectors the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune

BITS, CHUNKS, WIDTH = 128, 16, 8
SAMPLE, BLOCK, QUERY_BLOCK, KEEP, SEED = 20_000, 16_384, 4096, 0.98, 5


@dataclass
class Codes:
    """A lift by ``norm``, two maps to 64 signs each, and the radius to search."""

    norm: float
    maps: list[np.ndarray]
    radius: int

    def encode(self, x: np.ndarray, lift: bool) -> np.ndarray:
        """(n, 16) bytes. Candidates are lifted; queries get 0 as their last coordinate."""
        size = np.sqrt((x**2).sum(1, keepdims=True))
        scale = self.norm if lift else np.maximum(size, 1e-300)
        y = x / scale
        last = np.sqrt(np.maximum(0, 1 - (y**2).sum(1, keepdims=True))) if lift else np.zeros((len(x), 1))
        y = np.concatenate((y, last), axis=1)
        return np.concatenate([np.packbits(y @ m > 0, axis=1) for m in self.maps], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of one code to many."""
    return np.bitwise_count(b.view(np.uint64) ^ a.view(np.uint64)).sum(1)


def fit(sample: np.ndarray, norm: float, keep: float = KEEP, k: int = 20, seed: int = SEED, rounds: int = 15) -> Codes:
    rng = np.random.default_rng(seed)
    y = sample / norm
    y = np.concatenate((y, np.sqrt(np.maximum(0, 1 - (y**2).sum(1, keepdims=True)))), axis=1)
    half = BITS // 2
    basis = np.linalg.svd(y, full_matrices=False)[2][:half].T
    if basis.shape[1] < half:  # fewer dimensions than bits: repeat directions under random mixing
        basis = basis @ rng.normal(size=(basis.shape[1], half))
    v, maps = y @ basis, []
    for _ in range(2):
        turn = np.linalg.qr(rng.normal(size=(half, half)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        maps.append(basis @ turn)
    out = Codes(norm, maps, BITS)
    picked = rng.permutation(len(sample))[:256]
    codes, asked = out.encode(sample, True), out.encode(sample[picked], False)
    reach = []
    for i, code in zip(picked, asked, strict=True):
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(score) - 1))[:k]
        reach.append(_distances(code, codes[near]))
    out.radius = int(np.quantile(np.concatenate(reach), keep)) if len(sample) > k else BITS
    return out


class Index:
    """Codes of a block with lists by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.lists, self.starts = [], []
        for c in range(CHUNKS):
            order = np.argsort(codes[:, c], kind="stable")
            self.lists.append(order)
            self.starts.append(np.searchsorted(codes[order, c], np.arange(257)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All codes within ``radius``: probe each substring's lists, then check whole codes."""
        low, more = divmod(radius + 1, CHUNKS)
        seen = np.zeros(len(self.codes), bool)
        for c in range(CHUNKS):
            allowed = low + (c < more) - 1  # the radii plus one sum to radius + 1
            if allowed < 0:
                continue
            if allowed >= WIDTH:
                seen[:] = True
                break
            values = _NEAR[allowed] ^ code[c]
            begin, end = self.starts[c][values], self.starts[c][values + 1]
            size = end - begin
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            seen[self.lists[c][at]] = True
        if 2 * np.count_nonzero(seen) > len(seen):  # cheaper over all than over copies of most
            return np.flatnonzero(seen & (_distances(code, self.codes) <= radius))
        found = np.flatnonzero(seen)
        return found[_distances(code, self.codes[found]) <= radius]


_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))
#: Values of a substring with at most so many ones.
_NEAR = [np.flatnonzero(_ONES <= r) for r in range(WIDTH + 1)]


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, v (doubles) of the vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def search(candidates: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, block: int = BLOCK, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest candidates found for each query."""
    schema = "query_id long, vec_id long, score double"
    tune(candidates.sparkSession)
    every, asked = usable(candidates, id_, vector), usable(queries, id_, vector)
    drawn = every.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample).toPandas()  # ``sample`` vectors at most
    if not len(drawn):
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = int(drawn["v"].map(len).mode()[0])
    every, asked = every.where(F.size("v") == width), asked.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))
    repeats = not every.groupBy("id").count().where("count > 1").isEmpty()
    if repeats:
        every = every.distinct()
    norm, n = every.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), F.count("*")).first()
    codes = fit(np.stack(drawn.loc[drawn["v"].map(len) == width, "v"]), norm)
    n_blocks, n_queries = -(-n // block), max(1, -(-asked.count() // QUERY_BLOCK))
    held = candidates.sparkSession.sparkContext.broadcast(codes)  # two maps of fixed size

    part = lambda n, *of: F.pmod(F.xxhash64("id", *of), F.lit(n)).cast("int")
    left = every.select("id", "v", F.lit(False).alias("asks"), part(n_blocks, "v").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("part"))
    right = asked.select("id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), part(n_queries).alias("part"))

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        v, ids = np.stack(rows["v"]), rows["id"].to_numpy()
        order = np.argsort(ids[~asks], kind="stable")
        x, x_ids, q, q_ids = v[~asks][order], ids[~asks][order], v[asks], ids[asks]
        index = Index(held.value.encode(x, True))
        askers, ids_found, scores = [], [], []
        for code, query, own in zip(held.value.encode(q, False), q, q_ids, strict=True):
            radius = held.value.radius
            found = index.within(code, radius)
            while len(found) < k + 1 and radius < BITS:
                radius = min(BITS, radius + 8)
                found = index.within(code, radius)
            found = found[x_ids[found] != own]
            score = x[found] @ query
            best = np.lexsort((x_ids[found], -score))
            if repeats:  # each id once, at its best
                best = best[np.sort(np.unique(x_ids[found[best]], return_index=True)[1])]
            best = best[:k]
            askers.append(np.full(len(best), own))
            ids_found.append(x_ids[found[best]])
            scores.append(score[best])
        return pd.DataFrame({"query_id": np.concatenate(askers), "vec_id": np.concatenate(ids_found), "score": np.concatenate(scores)})

    found = left.unionByName(right).groupBy("block", "part").applyInPandas(probe, schema)
    if repeats:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
