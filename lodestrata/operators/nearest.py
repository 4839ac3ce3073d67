"""The best rows of many queries, by blocks: a task holds one block of queries and one of rows, and hands on what is best there.

Every query meets every row, so the work grows with their product. What is shuffled doesn't: rows go to each block of
queries and queries to each block of rows, and of a pair of blocks only ``k`` rows a query go on. Scores are products of
matrices, so that a task's memory is bounded by the blocks and by ``AT_ONCE`` queries. Blocks are dealt by hashes of ids over
all workspaces; a task takes the workspaces in its block one by one, and nothing crosses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and rows in a block, queries scored at once, chunks whose postings are a matrix, and its most terms.
QUERIES, VECTORS, CHUNKS, AT_ONCE, NARROW, HOT = 32_768, 32_768, 8192, 256, 4096, 2048
#: Rows that are too few for a block of their own, however many cores there are; products in a group of which one is kept at first.
LEAST, GROUP = 256, 32


def _met(queries: DataFrame, rows: DataFrame, tie: str, n_queries: int, n_rows: int, size: int, meet, schema: str) -> DataFrame:
    """``meet(queries, rows)`` over all pairs of blocks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across, down = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // size), min(2 * cores, n_rows // LEAST))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # names of their own: both may be parts of one table, whose columns would be taken for each other
    q = queries.select(block("query_id", across).alias("_q"), every(down).alias("_c"), *[F.col(c).alias(f"asked_{c}") for c in queries.columns])
    c = rows.select(every(across).alias("_q"), block(tie, down).alias("_c"), *rows.columns)
    n = 2 * across * down  # few bytes may be much work: these tasks aren't to be joined
    q, c = (x.repartition(n, "_q", "_c").groupBy("_q", "_c") for x in (q, c))
    return q.cogroup(c).applyInArrow(meet, schema)


def _by_workspace(queries: pa.Table, rows: pa.Table, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each workspace, in their order, and the queries that meet them."""
    codes = pa.chunked_array([*rows["workspace_id"].chunks, *queries["asked_workspace_id"].chunks], rows.schema.field("workspace_id").type) if within else rows["workspace_id"]
    codes = pc.fill_null(codes.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    own, asked = codes[: len(rows)], codes[len(rows) :]
    order, by = np.argsort(own, kind="stable"), np.argsort(asked, kind="stable")
    values, starts = np.unique(own[order], return_index=True)
    ends = np.append(starts[1:], len(own))
    first, last = (np.searchsorted(asked[by], values, side) for side in ("left", "right"))
    for a, b, x, y in zip(starts, ends, first, last, strict=True):
        some = by[x:y] if within else np.arange(len(queries))
        if len(some):
            yield order[a:b], some


def _firsts(row: np.ndarray, k: int) -> np.ndarray:
    """Which of the sorted numbers are among the first ``k`` of equal ones."""
    head = np.flatnonzero(np.diff(row, prepend=-1))
    return np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row)))) < k


# vectors

#: No product of such numbers overflows.
_LARGE = 1e100


def finite(vector: Column) -> Column:
    """Whether a vector has numbers, all of them finite and none huge."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < _LARGE, F.lit(False))), F.lit(False))


def plain(vector: Column, width: int) -> Column:
    """Whether a vector is :func:`finite` and has ``width`` numbers."""
    return F.coalesce((F.size(vector) == width) & finite(vector), F.lit(False))


def _distinct(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of all equal vectors: none of the others can be among the ``k`` best."""
    odd = np.random.default_rng(0).integers(0, 1 << 62, x.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h = (np.ascontiguousarray(x).view(np.uint64) * odd).sum(1)
    order = np.argsort(h, kind="stable")
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(1))
    return np.sort(order[_firsts(np.cumsum(new), k)])


def best_vectors(y: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector of ``y`` the ``k`` of ``x`` with the largest inner products, of equal ones the first: places in both, and
    products. A product of matrices picks what may be among them; products that count are summed up from left to right."""
    kept = _distinct(x, k)
    x = x[kept]
    slack = 8 * x.shape[1] * np.finfo(float).eps * np.sqrt((x**2).sum(1).max()) * np.sqrt((y**2).sum(1))
    step = max(1, AT_ONCE // 4)
    products = np.empty((min(step, len(y)), len(x)))
    for at in range(0, len(y), step):
        part = y[at : at + step]
        rough = np.matmul(part, x.T, out=products[: len(part)])
        row, col = np.divmod(np.flatnonzero(rough >= (_reached(rough, k) - slack[at : at + step])[:, None]), len(x))
        score = np.concatenate([np.zeros(0), *(np.cumsum(y[at + row[i : i + 65536]] * x[col[i : i + 65536]], axis=1)[:, -1] for i in range(0, len(row), 65536))])
        order = np.lexsort((col, -score, row))
        order = order[_firsts(row[order], k)]
        yield at + row[order], kept[col[order]], score[order]


def _reached(score: np.ndarray, k: int) -> np.ndarray:
    """For each row a number that ``k`` of its numbers reach at least, and no more than the greatest ``GROUP * k`` but for equal
    ones: the ``k``-th of the greatest of groups, as reading all numbers once takes less than parting them."""
    n = score.shape[1]
    if n <= k:
        return np.full(len(score), -np.inf)
    groups = max(8 * k, -(-n // GROUP))
    most = score[:, :groups].copy()
    for a in range(groups, n, groups):
        part = score[:, a : a + groups]
        np.maximum(most[:, : part.shape[1]], part, out=most[:, : part.shape[1]])
    return np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in column.chunks]).reshape(len(column), -1)


def dense(queries: DataFrame, chunks: DataFrame, k: int, n_queries: int, n_chunks: int, within: bool = True, odd: bool = False) -> DataFrame:
    """query_id, workspace_id (of the chunk), chunk_id, score: rows among which are the ``k`` best of each query in its
    workspace, or (not ``within``) in every workspace. Vectors have the same number of plain numbers, or (``odd``) are any."""
    kind = dict(chunks.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, workspace_id {kind['workspace_id']}, chunk_id {kind['chunk_id']}, score double"

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        asked, places, scores, unknown = ([np.zeros(0, t)] for t in (int, int, float, bool))
        c = c.take(pc.sort_indices(c, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
        if len(q) and len(c):
            of = _Ragged if odd else _vectors
            y, x = of(q["asked_dense"]), of(c["dense"])
            for own, some in _by_workspace(q, c, within):
                for row, col, score, null in best_ragged(y, x, some, own, k) if odd else ((*best, None) for best in best_vectors(y[some], x[own], k)):
                    asked.append(some[row]), places.append(own[col]), scores.append(score), unknown.append(np.zeros(len(row), bool) if null is None else null)
        asked, places, scores, unknown = (np.concatenate(a) for a in (asked, places, scores, unknown))
        q, c = q["asked_query_id"].take(pa.array(asked)), c.select(["workspace_id", "chunk_id"]).take(pa.array(places))
        return pa.table({"query_id": q, "workspace_id": c["workspace_id"], "chunk_id": c["chunk_id"], "score": pa.array(scores, mask=unknown)})

    columns = ["query_id", "workspace_id", "dense"] if within else ["query_id", "dense"]
    return _met(queries.select(*columns), chunks.select("workspace_id", "chunk_id", "dense"), "chunk_id", n_queries, n_chunks, VECTORS, meet, schema)


# vectors of any kind


class _Ragged:
    """Vectors of any widths; the width of those that give no product, as they are null or hold a null, is -1."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        values = lists.flatten()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
        self.start, self.width = np.cumsum(size) - size, size.copy()
        self.width[pc.is_null(lists).to_numpy(zero_copy_only=False)] = -1
        self.width[np.repeat(np.arange(len(size)), size)[pc.is_null(values).to_numpy(zero_copy_only=False)]] = -1
        self.values = values.to_numpy(zero_copy_only=False).astype(float)

    def of(self, places: np.ndarray, width: int) -> np.ndarray:
        return self.values[self.start[places][:, None] + np.arange(width)]


def _in_order(score: np.ndarray) -> np.ndarray:
    """Integers in the order of numbers as Spark sorts them: zeros are equal, and what is no number is the largest."""
    bits = (score + 0.0).view(np.int64)
    return np.where(np.isnan(score), np.iinfo(np.int64).max, bits ^ ((bits >> 63) & np.iinfo(np.int64).max))


def best_ragged(y: _Ragged, x: _Ragged, some: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the vectors ``some`` of ``y`` the ``k`` of ``own`` of ``x`` with the largest inner products, of equal ones the
    first: places in ``some`` and ``own``, products, and whether a product is null (these come last). Products are summed up
    from left to right; those of vectors of other widths are null."""
    for width in np.unique(y.width[some]):
        rows = np.flatnonzero(y.width[some] == width)
        fit = x.width[own] == width if width >= 0 else np.zeros(len(own), bool)
        cols, rest = np.flatnonzero(fit), np.flatnonzero(~fit)
        rest = rest[: max(0, k - len(cols))]
        yield np.repeat(rows, len(rest)), np.tile(rest, len(rows)), np.zeros(len(rows) * len(rest)), np.ones(len(rows) * len(rest), bool)
        if not len(cols):
            continue
        across = np.ascontiguousarray(x.of(own[cols], width).T)
        for at in range(0, len(rows), AT_ONCE // 4):
            part = rows[at : at + AT_ONCE // 4]
            left, score = y.of(some[part], width), np.zeros((len(part), len(cols)))
            with np.errstate(invalid="ignore", over="ignore"):
                for j in range(width):
                    score += left[:, j, None] * across[j]
            row, col = np.nonzero(_most(_in_order(score), k))
            yield part[row], cols[col], score[row, col], np.zeros(len(row), bool)


def _most(key: np.ndarray, k: int) -> np.ndarray:
    """Which are the ``k`` largest of each row, of equal ones the first."""
    n = key.shape[1]
    if n <= k:
        return np.ones(key.shape, bool)
    least = np.partition(key, n - k, axis=1)[:, n - k, None]
    above, equal = key > least, key == least
    return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1)[:, None]))


# terms


def best_sums(asks: tuple[np.ndarray, np.ndarray], postings: tuple[np.ndarray, np.ndarray, np.ndarray], n_queries: int, n_chunks: int, n_terms: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``asks`` (query, term) and ``postings`` (term, chunk, weight), as places -> for each query the ``k`` chunks of the
    greatest sums of the weights of its terms, rounded to nine digits, of equal ones the first. Terms of many chunks are
    multiplied as matrices, the others' postings are added one by one."""
    query, asked = (a[np.argsort(asks[0], kind="stable")] for a in asks)
    by_chunk = np.argsort(postings[1], kind="stable")
    term, chunk, weight = (p[by_chunk] for p in postings)
    for low in range(0, n_chunks, NARROW):
        n = min(NARROW, n_chunks - low)
        a, b = np.searchsorted(chunk, (low, low + n))
        order = np.argsort(term[a:b], kind="stable") + a
        t, c, w = term[order], chunk[order] - low, weight[order]
        df = np.bincount(t, minlength=n_terms)
        head = np.cumsum(df) - df
        hot = np.argsort(-df, kind="stable")[:HOT]
        hot = hot[df[hot] * 32 >= n]
        place = np.full(n_terms, -1)
        place[hot] = np.arange(len(hot))
        own = place[t] >= 0
        matrix = np.bincount(place[t[own]] * n + c[own], w[own], len(hot) * n).reshape(len(hot), n)
        for at in range(0, n_queries, AT_ONCE):
            m = min(AT_ONCE, n_queries - at)
            x, y = np.searchsorted(query, (at, at + m))
            q, u = query[x:y] - at, asked[x:y]
            own = place[u] >= 0
            sums = np.bincount(q[own] * len(hot) + place[u[own]], minlength=m * len(hot)).reshape(m, len(hot)).astype(float) @ matrix
            q, u = q[~own], u[~own]
            step = np.cumsum(df[u])
            for i, j in slices(step, 1 << 22):
                size = df[u[i:j]]
                at_ = np.repeat(head[u[i:j]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                sums += np.bincount(np.repeat(q[i:j], size) * n + c[at_], w[at_], m * n).reshape(m, n)
            least = np.partition(sums, n - k, axis=1)[:, n - k] - 2e-9 if n > k else np.full(m, -np.inf)
            row, col = np.nonzero((sums >= least[:, None]) & (sums > 0))
            score = sums[row, col]
            order = np.lexsort((col, -np.round(score, 9), row))
            order = order[_firsts(row[order], k)]
            yield at + row[order], low + col[order], score[order]


def slices(step: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of what has the running sums ``step``, of ``most`` and one more at most."""
    i = 0
    while i < len(step):
        j = max(i + 1, int(np.searchsorted(step, (step[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def sparse(queries: DataFrame, postings: DataFrame, k: int, n_queries: int, n_chunks: int) -> DataFrame:
    """``queries`` (query_id, workspace_id, terms: an array, terms that repeat count again) and ``postings`` (workspace_id,
    chunk_id, term, w: above 0) -> query_id, chunk_id, score: rows among which are the ``k`` best of each query."""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(postings.dtypes)['chunk_id']}, score double"

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        asked, places, scores = ([np.zeros(0, t)] for t in (int, int, float))
        code = p["chunk_id"].combine_chunks().dictionary_encode()
        ids = code.dictionary
        if len(q) and len(p):
            by_id = pc.sort_indices(ids).to_numpy()
            place = np.empty(len(ids), int)
            place[by_id] = np.arange(len(ids))
            ids, chunk = ids.take(pa.array(by_id)), place[code.indices.to_numpy()]
            words = p["term"].combine_chunks().dictionary_encode()
            term, weight, lists = words.indices.to_numpy().astype(int), p["w"].to_numpy(), q["asked_terms"].combine_chunks()
            query, known = pc.list_parent_indices(lists).to_numpy(), pc.index_in(lists.flatten(), value_set=words.dictionary)
            met = known.is_valid().to_numpy(zero_copy_only=False)
            query, known = query[met], pc.fill_null(known, 0).to_numpy(zero_copy_only=False)[met].astype(int)
            at = np.full(len(q), -1)
            for own, some in _by_workspace(q, p, True):
                at[some] = np.arange(len(some))
                mine = at[query] >= 0
                used, local = np.unique(chunk[own], return_inverse=True)
                for row, col, score in best_sums((at[query[mine]], known[mine]), (term[own], local, weight[own]), len(some), len(used), len(words.dictionary), k):
                    asked.append(some[row]), places.append(used[col]), scores.append(score)
                at[some] = -1
        asked, places, scores = (np.concatenate(a) for a in (asked, places, scores))
        return pa.table({"query_id": q["asked_query_id"].take(pa.array(asked)), "chunk_id": ids.take(pa.array(places)), "score": scores})

    return _met(queries.select("query_id", "workspace_id", "terms"), postings.select("workspace_id", "chunk_id", "term", "w"), "chunk_id", n_queries, n_chunks, CHUNKS, meet, schema)
