"""Registered queries of the engine, each over its whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import ids, text
from lodestrata.functions.vectors import norm
from lodestrata.operators import compose, diff, embed, evaluate, feedback, impacts, jobs, order, registry, retrieve, segment, sessions, sync, upkeep
from lodestrata.settings import Settings
from lodestrata.sources import files
from lodestrata.sources.convert import convert_contents, convert_text

from . import storage
from . import tables as t
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
SETTINGS = Settings()


def child_windows(spark: SparkSession, d: str) -> DataFrame:
    cut = t.spread(t.files(spark, d)).select("doc_id", F.posexplode(segment.windows(F.col("text"), SETTINGS.child_size, SETTINGS.child_overlap)).alias("child_index", "text"))
    return cut.select("doc_id", F.col("child_index").cast("long").alias("child_index"), "text")


def parent_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = t.files(spark, d).select("doc_id", "file_name", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    return rows.select("doc_id", F.col("i").cast("long").alias("parent_index"), ids.parent_id(F.col("file_name"), F.col("i")).alias("parent_id"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    cut = t.markdown(spark, d).select("doc_id", F.posexplode(segment.sections(F.col("markdown"))).alias("i", "s"))
    return cut.select("doc_id", F.col("i").cast("long").alias("section"), F.col("s.label").alias("label"), F.col("s.text").alias("text"))


def merged_sections(spark: SparkSession, d: str) -> DataFrame:
    cut = t.markdown(spark, d).select("doc_id", segment.sections(F.col("markdown")).alias("s")).select("doc_id", F.posexplode(segment.merged(F.col("s"), SETTINGS.merge_below)).alias("i", "m"))
    return cut.select("doc_id", F.col("i").cast("long").alias("parent"), F.col("m.label").alias("label"), F.col("m.text").alias("text"))


def packed_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = t.spread(t.files(spark, d)).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")).select("doc_id", F.posexplode(segment.packed(F.col("text"), SETTINGS.split_above)).alias("i", "text"))
    return pieces.select("doc_id", F.col("i").cast("long").alias("piece"), "text")


def parents(spark: SparkSession, d: str) -> DataFrame:
    return segment.parents(t.markdown(spark, d), SETTINGS)


def children(spark: SparkSession, d: str) -> DataFrame:
    return segment.children(parents(spark, d), SETTINGS)


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    packed = t.files(spark, d).select("doc_id", ids.pack_fingerprint(F.sha2(F.col("text").cast("binary"), 256), F.octet_length("text")).alias("packed"))
    parsed = ids.parse_fingerprint(F.col("packed"))
    return packed.select("doc_id", "packed", parsed["digest"].alias("digest"), parsed["size"].alias("size_bytes"))


def type_gate(spark: SparkSession, d: str) -> DataFrame:
    kind = text.file_type("file_name")
    return t.files(spark, d).select("doc_id", kind.alias("file_type"), kind.isin(*SETTINGS.supported_types).alias("supported"))


def conversion_outcomes(spark: SparkSession, d: str) -> DataFrame:
    found = convert_text(F.col("file_type"), F.col("text").cast("binary"), SETTINGS)
    return t.files(spark, d).select("doc_id", found.alias("c")).select("doc_id", "c.outcome", "c.markdown", "c.reason")


def change_report(spark: SparkSession, d: str) -> DataFrame:
    return diff.detect_changes(t.on_disk(spark, d), t.registered(spark, d), ("workspace_id",))


def change_counts(spark: SparkSession, d: str) -> DataFrame:
    return change_report(spark, d).groupBy("workspace_id", "change").agg(F.count("*").alias("n"))


def removed_sweep(spark: SparkSession, d: str) -> DataFrame:
    return diff.by_change(change_report(spark, d), diff.REMOVED).select("workspace_id", "file_name", "document_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    done = diff.sync_results(change_report(spark, d), t.conversions(spark, d), ("workspace_id",))
    return done.select(F.concat_ws("/", "workspace_id", "file_name").alias("id"), F.col("workspace_id").alias("sync_run_id"), "document_id", "file_name", "result", "reason")


def sync_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.run_counters(_items(spark, d))


def run_history(spark: SparkSession, d: str) -> DataFrame:
    runs = t.load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("string").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("string")).alias("finished_at"))
    return evaluate.run_history(runs)


def run_detail(spark: SparkSession, d: str) -> DataFrame:
    runs = t.workspaces(spark, d).select("id")
    detail = evaluate.with_details(runs, _items(spark, d), "sync_run_id", ["file_name", "result"], ["file_name"], "items")
    return detail.select("id", F.array_join(F.transform("items", lambda i: F.concat_ws("=", i["file_name"], i["result"])), ";").alias("items"))


def _registry(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    runs = t.workspaces(spark, d)
    return {
        "workspace": runs.select("id", F.col("id").alias("name"), F.lit("/").alias("folder_path"), "legal_flag", F.lit(None).cast("timestamp").alias("created_at")),
        "document": t.registered(spark, d).withColumn("last_synced_at", F.lit(None).cast("timestamp")),
        "sync_run": runs.select("id", F.col("id").alias("workspace_id"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), *[F.lit(0).alias(r) for r in evaluate.RESULTS]),
        "sync_item": _items(spark, d),
    }


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are left of each table when the legal workspaces go."""
    left = registry.cascaded(_registry(spark, d), "workspace", t.workspaces(spark, d).where("legal_flag"))
    counts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def set_null(spark: SparkSession, d: str) -> DataFrame:
    """The history when failed documents are deleted: it stays, without its references."""
    tables = _registry(spark, d)
    left = registry.cascaded(tables, "document", tables["document"].where("status = 'failed'"))
    return left["sync_item"].select("id", "document_id", "result")


def upsert(spark: SparkSession, d: str) -> DataFrame:
    """The registry after changed and new files were taken in."""
    changes = change_report(spark, d).where(F.col("change").isin(diff.NEW, diff.CHANGED))
    fresh = changes.select(
        F.coalesce("document_id", F.concat(F.lit("n"), "file_name")).alias("id"), "workspace_id", "file_name", "file_type", ids.pack_fingerprint(F.col("digest"), F.col("size_bytes")).alias("content_hash"),
        F.lit(None).cast("int").alias("page_count"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("last_synced_at"),
    )
    return registry.upserted(_registry(spark, d)["document"], fresh).select("id", "workspace_id", "file_name", "content_hash", "status")


def workspace_names(spark: SparkSession, d: str) -> DataFrame:
    named = t.load(spark, d, "customer").select("c_custkey", F.concat(F.lit(" \t"), "c_name", F.lit("\n ")).alias("name"))
    return registry.valid_names(named).select("c_custkey", "name", "valid")


def prefixed(spark: SparkSession, d: str) -> DataFrame:
    some = t.load(spark, d, "benchmark").where(F.length(text.strip("text")) > 0)
    return some.select("item_id", embed.passage(F.col("text")).alias("passage"), embed.query(F.col("text")).alias("query"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = t.load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("workspace_id"), F.col("embedding").alias("dense"))
    return vectors.where(F.col("chunk_id") % 20 == 0).withColumnRenamed("chunk_id", "query_id"), vectors


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.dense_top_k(*_vectors(spark, d), SETTINGS.top_k)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Each item, asked in each workspace."""
    asked = t.load(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, t.LANGUAGES))).alias("workspace_id"))
    return asked.select(F.concat_ws("/", "item_id", "workspace_id").alias("query_id"), "workspace_id", "text")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = t.spread(t.files(spark, d)).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("workspace_id"), "text")
    hits = retrieve.bm25_top_k(_questions(spark, d), chunks, SETTINGS.top_k, SETTINGS)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = storage.stored(t.embedded(spark, d), "embedded")
    queries = chunks.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "workspace_id", "text", "dense")
    return queries, chunks, retrieve.hybrid_top_k(queries, chunks, settings=SETTINGS)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[2].select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _parents_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks under a parent for each source of a workspace."""
    named = chunks.withColumn("parent_id", F.concat_ws("/", "workspace_id", "source"))
    rows = named.select("workspace_id", "parent_id", F.col("source").alias("source_file"), F.upper("source").alias("section_label"), F.col("parent_id").alias("text")).distinct()
    return named, rows


def parent_fetch(spark: SparkSession, d: str) -> DataFrame:
    _, chunks, hits = _hybrid(spark, d)
    named, rows = _parents_of(chunks)
    return retrieve.with_parents(hits, named, rows).select("query_id", "workspace_id", "parent_id", F.col("rank").cast("long").alias("rank"), "section_label")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the best rank over a score bound become sources; queries without one are refused."""
    queries, vectors = _vectors(spark, d)
    named, rows = _parents_of(vectors.withColumn("source", F.concat(F.lit("s"), F.floor(F.col("chunk_id") / 100))))
    good = retrieve.dense_top_k(queries, vectors, SETTINGS.top_k).where((F.col("score") > 0.45) & (F.col("chunk_id") != F.col("query_id")))
    spaces = vectors.select(F.col("workspace_id").alias("id"), (F.col("workspace_id") == "1").alias("legal_flag")).distinct()
    tries = queries.select("query_id", F.lit(0).alias("attempt"), F.col("query_id").cast("string").alias("search"))
    out = retrieve.answers(queries, retrieve.with_parents(good, named, rows), tries, spaces)
    sources = F.array_join(F.transform("sources", lambda s: s["file_name"]), ";")
    return out.select("query_id", "kind", "refusal", sources.alias("sources"), F.array_join("searched", ";").alias("searched"), "disclaimer", F.col("retries").cast("long").alias("retries"))


def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.evaluation_summary(t.evaluations(spark, d))
    return out.select("eval_run_id", F.round("groundedness", 6).alias("groundedness"), F.round("relevancy", 6).alias("relevancy"), F.col("refusal_pass").cast("long").alias("refusal_pass"), F.col("refusal_total").cast("long").alias("refusal_total"))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.release_gate(t.evaluations(spark, d), SETTINGS)
    return out.select("eval_run_id", F.round("groundedness", 6).alias("groundedness"), "all_sourced", "passed", F.array_join("failing", ",").alias("failing"))


def latency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency(t.load(spark, d, "documents").select((F.col("n_chars") / 100.0).cast("double").alias("seconds")))


def workspace_cap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.over_cap(t.registered(spark, d), SETTINGS)


def rough_sections(spark: SparkSession, d: str) -> DataFrame:
    cut = t.rough_markdown(spark, d).select("doc_id", F.posexplode(segment.sections(F.col("markdown"))).alias("i", "s"))
    return cut.select("doc_id", F.col("i").cast("long").alias("section"), F.col("s.label").alias("label"), F.col("s.text").alias("text"))


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """The text reader on marks, line ends and bytes of all kinds."""
    return t.raw_bytes(spark, d).select("doc_id", convert_text(F.lit("txt"), F.col("content"), SETTINGS).alias("c")).select("doc_id", "c.outcome", "c.markdown", "c.reason")


def pdf_files(spark: SparkSession, d: str) -> DataFrame:
    """The PDF reader on files that are whole, break off, or need a password."""
    return convert_contents(t.pdf_files(spark, d), "content", SETTINGS).select("item_id", "outcome", "markdown", F.col("page_count").cast("long").alias("page_count"), "reason")


def change_list(spark: SparkSession, d: str) -> DataFrame:
    return diff.in_order(change_report(spark, d), ("workspace_id",)).select("workspace_id", "ord", "file_name", "change")


def scan_list(spark: SparkSession, d: str) -> DataFrame:
    return diff.in_order(t.on_disk(spark, d), ("workspace_id",)).select("workspace_id", "ord", "file_name", "scan_state")


def _good_hits(hits: DataFrame) -> DataFrame:
    return hits.where((F.col("score") > 0.45) & (F.col("chunk_id") != F.col("query_id")))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries with a text, vectors under parents of a hundred, the parents, and workspaces."""
    queries, vectors = _vectors(spark, d)
    named, rows = _parents_of(vectors.withColumn("source", F.concat(F.lit("s"), F.floor(F.col("chunk_id") / 100))))
    spaces = vectors.select(F.col("workspace_id").alias("id"), (F.col("workspace_id") == "1").alias("legal_flag")).distinct()
    return queries.withColumn("text", F.col("query_id").cast("string")), named, rows, spaces


def _reworded(vectors: DataFrame):
    """Asks with the vector that has the next id instead (the same once there is none)."""

    def reword(queries: DataFrame, attempt: int) -> DataFrame:
        other = vectors.select((F.col("chunk_id") - attempt).alias("query_id"), F.col("dense").alias("_other"))
        moved = queries.join(other, "query_id", "left").withColumn("dense", F.coalesce("_other", "dense")).drop("_other")
        return moved.withColumn("text", F.concat(F.col("query_id").cast("string"), F.lit(f"+{attempt}")))

    return reword


def retried_answers(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a good hit are reworded and asked again, twice at most."""
    queries, chunks, parents, spaces = _asked(spark, d)
    out = retrieve.ask(queries, chunks, parents, spaces, lambda q, c: retrieve.dense_top_k(q, c, SETTINGS.top_k), _good_hits, _reworded(chunks), SETTINGS)
    sources = F.array_join(F.transform("sources", lambda s: s["file_name"]), ";")
    return out.select("query_id", "kind", sources.alias("sources"), F.array_join("searched", ";").alias("searched"), F.col("retries").cast("long").alias("retries"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    queries, chunks, parents, _ = _asked(spark, d)
    found = retrieve.with_parents(_good_hits(retrieve.dense_top_k(queries, chunks, SETTINGS.top_k)), chunks, parents)
    out = retrieve.traces(queries, found, queries.select("query_id", F.lit(0).alias("attempt"), F.col("text").alias("search")))
    return out.select("query_id", "workspace_id", F.array_join("searched", ";").alias("searched"), F.array_join("files", ";").alias("files"), F.col("retries").cast("long").alias("retries"))


def evaluation_reports(spark: SparkSession, d: str) -> DataFrame:
    gated = evaluate.release_gate(t.evaluations(spark, d), SETTINGS)
    gated = gated.select("eval_run_id", F.col("refusal_pass").cast("long").alias("refusal_pass"), F.col("refusal_total").cast("long").alias("refusal_total"), "all_sourced", "passed", "failing")
    return evaluate.reports(gated, "/reports", "2024-01-31")


def registry_state(spark: SparkSession, d: str) -> DataFrame:
    """A registry of its own: filled, its first workspace renamed, its second flagged, its last deleted."""
    reg = registry.Registry(spark, f"{storage.shared_folder(spark)}/registry-{uuid.uuid4().hex}", SETTINGS)
    began = F.lit("2024-01-31 12:00:00").cast("timestamp")
    spaces = t.workspaces(spark, d).select("id", F.col("id").alias("name"), F.concat(F.lit("/"), "id").alias("folder_path"), "legal_flag", began.alias("created_at"))
    docs = t.registered(spark, d).where("workspace_id is not null").withColumn("last_synced_at", began)
    runs = spaces.select("id", F.col("id").alias("workspace_id"), began.alias("started_at"), began.alias("finished_at"), *[F.lit(0).alias(r) for r in evaluate.RESULTS])
    with reg.transaction() as draft:
        draft.add("workspace", spaces)
        draft.add("document", docs)
        draft.add("sync_run", runs)
    with reg.transaction() as draft:
        draft.add("sync_item", _items(spark, d).where("sync_run_id is not null"))
    known = [w.id for w in reg.list_workspaces().collect()]  # as many as sources
    reg.rename_workspace(known[0], f"  {known[0]} renamed\u00a0")
    reg.set_legal_flag(known[1], True)
    reg.delete_workspace(known[-1])
    count = lambda name, key: reg.table(name).groupBy(F.col(key).alias("id")).agg(F.count("*").alias(f"{name}s"))
    rows = reg.list_workspaces().select("id", "name", "folder_path", "legal_flag")
    for name, key in (("document", "workspace_id"), ("sync_run", "workspace_id"), ("sync_item", "sync_run_id")):
        rows = rows.join(count(name, key), "id", "left").withColumn(f"{name}s", F.coalesce(f"{name}s", F.lit(0)).cast("long"))
    return rows


def stale_tail(spark: SparkSession, d: str) -> DataFrame:
    """What a chunk store shows after a second version in which a third of the files got shorter and a third lost all rows."""
    folder = f"{storage.shared_folder(spark)}/sync-{uuid.uuid4().hex}"
    reg = registry.Registry(spark, f"{folder}/registry", SETTINGS)
    store = sync.ChunkStore(reg, f"{folder}/store")
    space = F.lit(reg.create_workspace("w", "/w")).alias("workspace_id")
    first = t.markdown(spark, d)
    third = F.pmod(F.col("doc_id"), F.lit(3))
    short = F.concat(F.lit("# doc "), F.col("doc_id").cast("string"), F.when(third == 0, F.concat(F.lit("\n\nshort "), F.col("doc_id").cast("string"))).otherwise(F.lit("\n")))
    second = first.where(third < 2).withColumn("markdown", short)
    for version, files in (("1", first), ("2", second)):
        parents_, children_ = segment.chunk(files.select(space, "source_file", "markdown"), SETTINGS)
        made = store.write(parents_, children_, version)
        with reg.transaction() as draft:
            draft["chunk_file"] = store.switched(draft["chunk_file"], files.select(space, "source_file"), made)
    known = store.parents(reg.list_workspaces().first().id)
    return known.select("source_file", F.col("parent_index").cast("long").alias("parent_index"), "section_label", "text")


def embedded_passages(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all items, made and checked where their rows are."""
    settings = replace(SETTINGS, dense_width=32)
    rows = t.load(spark, d, "benchmark").where(F.length(text.strip("text")) > 0)
    made = embed.embed_passages(rows, embed.HashEncoder(32), "query", settings=settings)
    return made.select("item_id", F.size("dense").cast("long").alias("width"), F.round(norm(F.col("dense")), 5).alias("norm"))


def folder_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the tables' own folder, hashed where they are listed, with their places by name."""
    rows = files.folder_files(spark, d, ("parquet",)).where("scan_state = 'ok'")
    return order.placed(rows.select("file_name", "digest", "size_bytes"), ("file_name",))


SYNC_WAVE = 25


def sync_progress(spark: SparkSession, d: str) -> DataFrame:
    """What two syncs in the background report of a folder with a file for each benchmark item, in waves of ``SYNC_WAVE``: one
    that runs to its end, and one that is cancelled after its first wave; with the documents that each left in the registry."""
    folder = f"{storage.shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    t.write_files(t.load(spark, d, "benchmark").select(F.format_string("%08d.md", "item_id").alias("file_name"), "text"), f"{folder}/docs")
    reg = registry.Registry(spark, f"{folder}/registry", SETTINGS)
    store = sync.ChunkStore(reg, f"{folder}/store")
    settings = replace(SETTINGS, wave_files=SYNC_WAVE)
    stop = lambda job, row: job.cancel() if row["state"] == "stored" else None
    for name, watch in (("whole", None), ("cut", stop)):
        job = jobs.start_sync(reg, store, reg.create_workspace(name, f"{folder}/docs"), settings=settings, watch=watch)
        job.wait()
        if job.error is not None and not isinstance(job.error, sync.SyncCancelled):
            raise job.error
    known = reg.table("document").groupBy("workspace_id").agg(F.count("*").alias("documents"))
    rows = jobs.progress(reg).join(reg.table("workspace").select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace")), "workspace_id").join(known, "workspace_id")
    return rows.select("workspace", "seq", "state", "done", "total", "documents")


BLOCK = 16


def _by_blocks(spark: SparkSession, d: str) -> impacts.Found:
    folder = f"{storage.shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    chunks = t.spread(t.files(spark, d)).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("workspace_id"), "text")
    impacts.write_index(chunks, folder, block=BLOCK)
    return impacts.top_k(_questions(spark, d), impacts.read_index(spark, folder), SETTINGS.top_k, SETTINGS)


def block_topk(spark: SparkSession, d: str) -> DataFrame:
    """What ``bm25_topk`` finds, from a written index of which most blocks are skipped."""
    return _by_blocks(spark, d).hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def block_work(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that hold a term of each query, how many of them are probed, and whether every one was probed, read or skipped."""
    work = _by_blocks(spark, d).work
    return work.select("query_id", "blocks", "probed", (F.col("probed") + F.col("read") + F.col("skipped") == F.col("blocks")).alias("accounted"))


def index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """What the items find in an index that followed a store through three versions: all documents; then a third shorter and a
    third gone; then a fifth written anew, also of those that were gone. Each document is one chunk."""
    folder = f"{storage.shared_folder(spark)}/upkeep-{uuid.uuid4().hex}"
    reg = registry.Registry(spark, f"{folder}/registry", SETTINGS)
    store = sync.ChunkStore(reg, f"{folder}/store")
    space = F.lit(reg.create_workspace("w", "/w")).alias("workspace_id")
    index = upkeep.LiveIndex(store, f"{folder}/index", fanout=2, block=BLOCK)
    docs = t.spread(t.files(spark, d)).select("doc_id", F.col("file_name").alias("source_file"), "text")
    half = F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    third = F.pmod(F.col("doc_id"), F.lit(3))
    second = docs.where(third < 2)
    versions = (
        ("1", docs, docs), ("2", second, second.where(third == 0).withColumn("text", half)),
        ("3", docs.where(F.pmod(F.col("doc_id"), F.lit(5)) == 0), docs.where(F.pmod(F.col("doc_id"), F.lit(5)) == 0).withColumn("text", F.concat("text", F.lit(" again")))),
    )
    for version, touched, left in versions:
        parents_ = left.select(space, "source_file", F.lit(0).alias("parent_index"), F.format_string("%012d", "doc_id").alias("parent_id"), F.lit(None).cast("string").alias("section_label"), "text")
        made = store.write(parents_, parents_.withColumn("child_index", F.lit(0)), version)
        with reg.transaction() as draft:
            draft["chunk_file"] = store.switched(draft["chunk_file"], touched.select(space, "source_file"), made)
        index.update(reg.list_workspaces().first().id)
    asked = t.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), space, "text")
    hits = impacts.top_k(asked, index.read(), SETTINGS.top_k, SETTINGS).hits
    return hits.select("query_id", F.split("chunk_id", "/")[0].cast("long").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def session_memory(spark: SparkSession, d: str) -> DataFrame:
    """What each turn of the conversations may refer to: four turns at most, none from before a new start."""
    turns = t.load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    starts = turns.where("(session_id + turn) % 5 = 3").select("session_id", "turn")
    out = sessions.with_memory(turns, starts, 4)
    return out.select("session_id", "turn", F.size("memory").cast("long").alias("remembered"), F.array_join(F.transform("memory", lambda m: F.concat_ws(":", m["role"], m["text"])), "\n").alias("memory"))


def clarified(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose best two parents are too close wait, with these as options; the reply is always the last option, and the
    search goes on with the hits of that parent."""
    queries, chunks, _, _ = _asked(spark, d)
    hits = retrieve.dense_top_k(queries, chunks, SETTINGS.top_k).join(chunks.select("chunk_id", "parent_id"), "chunk_id")
    hits = storage.stored(hits.where(F.col("chunk_id") != F.col("query_id")), "hits")
    on, wait = sessions.questions_back(queries.select("query_id"), hits, 0.05, 2)
    after = sessions.resumed(wait, wait.select("query_id", F.element_at("options", -1).alias("parent_id")), hits)
    rows = hits.join(on, "query_id").withColumn("options", F.lit("")).select("query_id", "options", "chunk_id", "rank")
    rows = rows.unionByName(after.join(wait.select("query_id", F.array_join("options", ";").alias("options")), "query_id").select("query_id", "options", "chunk_id", "rank"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.select("query_id", "options", "chunk_id", F.row_number().over(order).cast("long").alias("rank"))


def routed(spark: SparkSession, d: str) -> DataFrame:
    """The workspace that each query belongs to by its nearest vectors, asked in none."""
    queries, vectors = _vectors(spark, d)
    return retrieve.route_workspace(queries.select("query_id", "dense"), vectors, SETTINGS.top_k).select("query_id", "workspace_id", F.round("score", 6).alias("score"))


def latency_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all times from sketches stored by day, and whether their ranks are right to a hundredth."""
    times = t.load(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("day"), (F.col("n_chars") / 100.0).cast("double").alias("seconds"))
    found = evaluate.merged_latency(storage.stored(evaluate.latency_sketches(times, ("day",)), "sketches"))
    ranks = times.crossJoin(F.broadcast(found)).agg(  # one row of two numbers
        F.count("*").alias("n"), *[F.avg((F.col("seconds") <= F.col(q)).cast("double")).alias(f"{q}_most") for q in ("median", "p95")], *[F.avg((F.col("seconds") < F.col(q)).cast("double")).alias(f"{q}_least") for q in ("median", "p95")],
    )
    right = lambda q, p: (F.col(f"{q}_least") <= p + 0.01) & (F.col(f"{q}_most") >= p - 0.01)
    return ranks.select("n", right("median", 0.5).alias("median_right"), right("p95", 0.95).alias("p95_right"))


PAGE, SORTS = 50, {"name": ("file_name",), "type": ("file_type", "file_name"), "size": ("size_bytes", "file_name"), "state": ("scan_state", "file_name")}


def file_pages(spark: SparkSession, d: str) -> DataFrame:
    """The file table in each of its orders: the page of ``PAGE`` rows that a file is on, and its place there."""
    rows = t.on_disk(spark, d).select("file_name", "file_type", "scan_state", F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"))
    out = None
    for name, by in SORTS.items():
        one = order.placed(rows, by).select(F.lit(name).alias("sort"), F.floor(F.col("ord") / PAGE).alias("page"), (F.col("ord") % PAGE).alias("place"), "file_name")
        out = one if out is None else out.unionByName(one)
    return out


def written_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers written from the passages of good hits, here by quoting them; refusals list what was searched for."""
    queries, chunks, parents, spaces = _asked(spark, d)
    found = retrieve.with_parents(storage.stored(_good_hits(retrieve.dense_top_k(queries, chunks, SETTINGS.top_k)), "good"), chunks, parents)
    replies = retrieve.answers(queries, found, queries.select("query_id", F.lit(0).alias("attempt"), F.col("text").alias("search")), spaces)
    quote = lambda c: c.select("query_id", F.array_join(F.transform("passages", lambda p: F.concat_ws(": ", p["section_label"], p["text"])), "\n").alias("text"))
    return compose.written(replies, compose.contexts(queries, found), quote).select("query_id", "kind", "text")


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as answers to the turns before them, and events as marks on users' first answers."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    said = t.load(spark, d, "conversations").withColumn("question", F.lag("text").over(turn)).where("role = 'assistant'")
    replies = said.select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), F.concat(F.lit("w"), F.pmod(F.col("conv_id"), F.lit(4))).alias("workspace_id"), "question")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "up").when(F.col("event_type") == "error", "down").when(F.col("event_type") == "view", "none").otherwise(F.col("event_type"))
    said = F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise(F.lit(" "))
    marks = t.load(spark, d, "events").select(
        F.concat(F.col("user_id"), F.lit(":1")).alias("answer_id"), F.concat(F.lit("u"), F.col("event_id") % 7).alias("user_id"), kind.alias("mark"), said.alias("comment"), F.col("ts").cast("timestamp").alias("at")
    )
    return replies, marks


def feedback_refused(spark: SparkSession, d: str) -> DataFrame:
    """How many marks aren't kept, by reason."""
    answers_, marks = _marked(spark, d)
    return feedback.checked(marks, answers_).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def feedback_review(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose answers users mark down, with their comments."""
    answers_, marks = _marked(spark, d)
    return feedback.review(answers_, feedback.checked(marks, answers_).where("reason IS NULL")).drop("at")


def feedback_rates(spark: SparkSession, d: str) -> DataFrame:
    """By workspace, the share of marks that are down and its interval."""
    answers_, marks = _marked(spark, d)
    out = feedback.rates(answers_, feedback.checked(marks, answers_).where("reason IS NULL"))
    return out.select("workspace_id", "answers", "marked", "up", "down", *[F.round(c, 6).alias(c) for c in ("share_down", "low", "high")])


QUERIES = {
    f.__name__: f
    for f in (
        child_windows, parent_ids, sections, merged_sections, packed_pieces, parents, children, fingerprints, type_gate, conversion_outcomes, change_report, change_counts, removed_sweep, sync_items,
        run_rollup, run_history, run_detail, cascade_delete, set_null, upsert, workspace_names, prefixed, dense_topk, bm25_topk, hybrid_topk, parent_fetch, answers, evaluation_summary, release_gate,
        latency, workspace_cap, rough_sections, text_files, pdf_files, change_list, scan_list, retried_answers, traces, evaluation_reports, registry_state, stale_tail, embedded_passages, folder_files, sync_progress,
        block_topk, block_work, index_upkeep, session_memory, clarified, routed, latency_sketch, file_pages, feedback_refused, feedback_review,
        feedback_rates, written_answers,
    )
}
