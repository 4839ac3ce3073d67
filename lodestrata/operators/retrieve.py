"""Top-k retrieval inside workspaces: dense, sparse and hybrid, then the parents that hits stand for.

Queries and chunks meet by blocks (:mod:`nearest`), so that a workspace with a third of all chunks is dealt over many tasks,
and each task keeps its k best before anything is shuffled by query. Nothing ever crosses a workspace.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.plans.storage import stored
from lodestrata.settings import Settings

from . import nearest

#: Nothing reads FEW_QUERIES any more; it stays for callers that set it.
FEW_QUERIES, FEW_TERMS = 256, 100_000


def top(hits: DataFrame, k: int, by: Column, tie: str, salt: str | None = None) -> DataFrame:
    """The ``k`` best rows of each query_id with their rank; with ``salt``, of each part first."""
    if salt:
        part = Window.partitionBy("query_id", salt).orderBy(by.desc(), F.col(tie))
        hits = hits.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r", salt)
    whole = Window.partitionBy("query_id").orderBy(by.desc(), F.col(tie))
    return hits.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def _nearest(queries: DataFrame, chunks: DataFrame, k: int, within: bool = True) -> DataFrame:
    """query_id, workspace_id, chunk_id, score: rows among which are the ``k`` best of each query in its workspace, or in each.
    Vectors of another width than most, with nulls, or with numbers that aren't finite meet by blocks of their own."""
    q, c = queries.select("query_id", "workspace_id", "dense") if within else queries.select("query_id", "dense"), chunks.select("chunk_id", "workspace_id", "dense")
    if within:
        q, c = (x.where(F.col("workspace_id").isNotNull()) for x in (q, c))
    widths = c.groupBy(F.size("dense").alias("width")).agg(F.count("*").alias("n"), F.count_if(nearest.finite(F.col("dense"))).alias("fit"))
    n_c, most = widths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.struct("fit", "width"))).first()
    fit, width = most if most else (0, -1)
    good = nearest.plain(F.col("dense"), width)
    n_q, odd_q = q.agg(F.count("*"), F.count_if(~good)).first()
    plain_q, plain_c = q.where(good), c.where(good)
    out = nearest.dense(plain_q, plain_c, k, n_q - odd_q, fit, within)
    if odd_q:
        out = out.unionByName(nearest.dense(q.where(~good), c, k, odd_q, n_c, within, odd=True))
    if n_c > fit and n_q > odd_q:
        out = out.unionByName(nearest.dense(plain_q, c.where(~good), k, n_q - odd_q, n_c - fit, within, odd=True))
    return out


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``queries`` (query_id, workspace_id, dense), ``chunks`` (chunk_id, workspace_id, dense, ...) -> query_id,
    chunk_id, score, rank. Vectors are of unit length, so the score is the cosine."""
    return top(_nearest(queries, chunks, k).select("query_id", "chunk_id", "score"), k, F.col("score"), "chunk_id")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def words(text: Column) -> Column:
    """What :func:`terms` finds, with a space between terms: a string is written and read in a fraction of an array's time."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def n_words(words_: Column) -> Column:
    return F.when(words_ == "", 0).otherwise(F.length(words_) - F.length(F.replace(words_, F.lit(" "), F.lit(""))) + 1)


@dataclass
class SparseIndex:
    """What sparse search needs of its chunks: ``postings`` (workspace_id, chunk_id, length, term, tf: one for each term) and
    ``sizes`` (workspace_id, n, mean). A written index also has the terms' ``bucket``, by which a query's terms are read."""

    postings: DataFrame
    sizes: DataFrame
    written: bool = False

    def of(self, wanted: DataFrame) -> DataFrame:
        """The postings of ``wanted`` (workspace_id, term)."""
        rows = self.postings
        if self.written:  # only the folders of the terms' buckets are read; there are BUCKETS at most
            rows = rows.where(F.col("bucket").isin([r[0] for r in wanted.select(_bucket(F.col("term"))).distinct().collect()]))
        return rows.join(wanted, ["workspace_id", "term"], "left_semi")


BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(chunks: DataFrame, text: str = "text") -> DataFrame:
    """workspace_id, chunk_id, length, terms (distinct), tfs of each row. Terms are counted within the row, by the runs of its
    sorted terms: no task holds a table of the terms of all its rows."""
    return runs(chunks.select("workspace_id", "chunk_id", terms(F.col(text)).alias("t")))


def runs(tokens: DataFrame) -> DataFrame:
    """``tokens`` with length, terms and tfs in the place of their array ``t``."""
    had = [c for c in tokens.columns if c != "t"]
    rows = tokens.select(*had, F.sort_array("t").alias("t"))
    rows = rows.select("*", F.size("t").alias("length"), F.when(F.size("t") > 0, F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i) != F.element_at("t", F.greatest(i - 1, F.lit(1)))))).alias("starts"))
    ends = F.transform("starts", lambda s, i: (F.coalesce(F.try_element_at("starts", i + 2), F.col("length") + 1) - s).cast("long"))
    return rows.select(*had, "length", F.transform("starts", lambda s: F.element_at("t", s)).alias("terms"), ends.alias("tfs"))


def sparse_index(chunks: DataFrame, text: str = "text") -> SparseIndex:
    """The index of ``chunks`` (workspace_id, chunk_id, text) for the queries at hand: texts are cut into terms once."""
    rows = stored(counted(chunks, text), "tokens")
    sizes = rows.groupBy("workspace_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    key = ["workspace_id", "chunk_id", "length"]
    postings = rows.select(*key, F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(*key, "p.terms", "p.tfs").toDF(*key, "term", "tf")
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():  # rows that repeat a chunk_id and have as many terms add up
        postings = postings.groupBy(*key, "term").agg(F.sum("tf").alias("tf"))
    return SparseIndex(postings, sizes)


def write_index(chunks: DataFrame, folder: str, text: str = "text") -> None:
    """Write the postings of ``chunks`` below ``folder``, by buckets of terms, for any number of later queries."""
    index = sparse_index(chunks, text)
    index.postings.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    index.sizes.write.parquet(f"{folder}/sizes")


def read_index(spark: SparkSession, folder: str) -> SparseIndex:
    return SparseIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/sizes"), True)


def bm25_top_k(queries: DataFrame, chunks: DataFrame | SparseIndex, k: int, settings: Settings = Settings()) -> DataFrame:
    """``queries`` (query_id, workspace_id, text), ``chunks`` (chunk_id, workspace_id, text) or their index -> query_id,
    chunk_id, score, rank. idf is ln(1 + (N - df + 0.5) / (df + 0.5)); each distinct query term counts once. Rows without a
    common term are no hits. Only postings of terms that some query asks for go on to the joins."""
    k1, b = settings.bm25_k1, settings.bm25_b
    index = chunks if isinstance(chunks, SparseIndex) else sparse_index(chunks)
    asked = queries.where("workspace_id IS NOT NULL").select("query_id", "workspace_id", F.array_distinct(terms(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    asked = asked.groupBy("query_id", "workspace_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    wanted = asked.select("workspace_id", F.explode("terms").alias("term")).distinct()
    # a hot term's postings stay where they are if what is asked for was counted as small; else they are dealt by term
    small = F.broadcast if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS else lambda df: df
    found = index.of(small(wanted))
    frequency = found.groupBy("workspace_id", "term").agg(F.count("*").alias("df"))
    idf = frequency.join(index.sizes, "workspace_id").select("workspace_id", "term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    parts = found.join(small(idf), ["workspace_id", "term"]).select("workspace_id", "term", "chunk_id", weight.alias("w"))
    hits = nearest.sparse(asked, parts, k, asked.count(), index.sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return top(hits, k, F.round("score", 9), "chunk_id")


def fused_top_k(dense: DataFrame, sparse: DataFrame, k: int, settings: Settings = Settings()) -> DataFrame:
    """Reciprocal rank fusion of two result tables (query_id, chunk_id, rank)."""
    c = settings.fusion_constant
    both = dense.select("query_id", "chunk_id", "rank").unionByName(sparse.select("query_id", "chunk_id", "rank"))
    scored = both.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.col("rank") + c)).alias("score"))
    return top(scored, k, F.round("score", 12), "chunk_id")


def hybrid_top_k(queries: DataFrame, chunks: DataFrame, k: int | None = None, depth: int = 4, settings: Settings = Settings(), index: SparseIndex | None = None) -> DataFrame:
    """Dense and sparse results, ``depth`` times as deep as asked for, fused; with a written ``index``, texts aren't read."""
    k = k or settings.top_k
    return fused_top_k(dense_top_k(queries, chunks, depth * k), bm25_top_k(queries, index or chunks, depth * k, settings), k, settings)


def with_parents(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits traded for the parents they come from, each parent once per query at its best rank: query_id, workspace_id,
    parent_id, rank, source_file, section_label, text."""
    key = ["workspace_id", "parent_id"]
    named = hits.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", *key), "chunk_id")
    best = named.groupBy("query_id", *key).agg(F.min("rank").alias("rank"))
    return best.join(parents.select(*key, "source_file", "section_label", "text"), key).select("query_id", *key, "rank", "source_file", "section_label", "text")


def answers(queries: DataFrame, found: DataFrame, attempts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """One row per query: query_id, workspace_id, kind, refusal, sources, searched, disclaimer, retries. A query without
    a source is a refusal: an answer always has one. ``attempts`` (query_id, attempt, search) are the texts searched for."""
    sources = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source_file", "section_label"))), lambda s: F.struct(s["source_file"].alias("file_name"), s["section_label"].alias("section_label"))).alias("sources"))
    searched = attempts.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("attempt", "search"))), lambda a: a["search"]).alias("searched"))
    flags = workspaces.select(F.col("id").alias("workspace_id"), F.col("legal_flag").alias("disclaimer"))
    rows = queries.select("query_id", "workspace_id").join(sources, "query_id", "left").join(searched, "query_id", "left").join(flags, "workspace_id", "left")
    refused = F.col("sources").isNull()
    return rows.select(
        "query_id", "workspace_id", F.when(refused, "refusal").otherwise("answer").alias("kind"), refused.alias("refusal"), F.coalesce("sources", F.array().cast("array<struct<file_name:string,section_label:string>>")).alias("sources"),
        "searched", F.coalesce("disclaimer", F.lit(False)).alias("disclaimer"), (F.size("searched") - 1).alias("retries"),
    )


def traces(queries: DataFrame, found: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per query of what was done for it: query_id, workspace_id, searched (texts in order), files (that its sources
    come from, by best rank), retries."""
    files = found.groupBy("query_id", "source_file").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source_file"))), lambda f: f["source_file"]).alias("files"))
    searched = attempts.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("attempt", "search"))), lambda a: a["search"]).alias("searched"))
    rows = queries.select("query_id", "workspace_id").join(searched, "query_id", "left").join(files, "query_id", "left")
    none = F.expr("cast(array() as array<string>)")
    return rows.select("query_id", "workspace_id", F.coalesce("searched", none).alias("searched"), F.coalesce("files", none).alias("files"), F.greatest(F.size(F.coalesce("searched", none)) - 1, F.lit(0)).alias("retries"))


def append_traces(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def ask(
    queries: DataFrame, chunks: DataFrame, parents: DataFrame, workspaces: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame],
    grade: Callable[[DataFrame], DataFrame], reword: Callable[[DataFrame, int], DataFrame], settings: Settings = Settings(), trace_folder: str | None = None,
) -> DataFrame:
    """Search, grade, reword and search again, ``retry_ceiling`` times at most, for the queries without a good hit. With
    ``trace_folder``, what was done for each query is appended there.

    ``search(queries, chunks)`` gives hits, ``grade(hits)`` keeps the good ones, ``reword(queries, attempt)`` changes
    texts and vectors. The loop is over attempts; each handles all open queries at once."""
    open_, kept, tries = queries, None, None
    for attempt in range(settings.retry_ceiling + 1):
        good = stored(grade(search(open_, chunks)), "good")  # read by what follows, and by each later attempt
        this = open_.select("query_id", F.lit(attempt).alias("attempt"), F.col("text").alias("search"))
        kept, tries = (good, this) if kept is None else (kept.unionByName(good), tries.unionByName(this))
        open_ = open_.join(good.select("query_id").distinct(), "query_id", "left_anti")
        if attempt == settings.retry_ceiling or open_.isEmpty():
            break
        open_ = stored(reword(open_, attempt + 1), "open")
    found = with_parents(kept, chunks, parents)
    if trace_folder:
        append_traces(traces(queries, found, tries), trace_folder)
    return answers(queries, found, tries, workspaces)


def route_workspace(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The workspace whose ``k`` best chunks have the largest sum of scores, for queries (query_id, dense) without one."""
    scored = _nearest(queries, chunks, k, within=False).select(F.struct("query_id", "workspace_id").alias("query_id"), "chunk_id", "score")
    sums = top(scored, k, F.col("score"), "chunk_id").groupBy("query_id").agg(F.sum("score").alias("score")).select("query_id.*", "score")
    return top(sums, 1, F.round("score", 9), "workspace_id").select("query_id", "workspace_id", "score")
