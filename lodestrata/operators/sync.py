"""One sync of a workspace: scan, compare, convert, segment, embed, and bring registry and stores up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import pack_fingerprint
from lodestrata.plans.storage import stored
from lodestrata.settings import Settings
from lodestrata.sources.convert import convert_files
from lodestrata.sources.files import scan_folder
from lodestrata.sources.readers import READERS

from . import diff, embed, evaluate, segment
from .order import placed
from .registry import TABLES, Registry, RegistryError, SyncInProgress, now, upserted


_PARENT = "parent_index int, parent_id string, section_label string"
_KEYS = "source_file string, workspace_id string, version string"
STORED = {"parents": f"{_PARENT}, text string, {_KEYS}", "children": f"{_PARENT}, child_index int, text string, dense array<float>, {_KEYS}"}


@dataclass
class ChunkStore:
    """Parents and children of files, in folders by workspace and version. A version is written whole before anything
    points to it; the registry's ``chunk_file`` says which version holds a file's rows, and readers see only those. So a
    file's old rows go the moment the registry switches, also those of a file that grew shorter or has no rows left."""

    registry: Registry
    path: str

    def _folder(self, name: str):
        at = self.registry.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.registry.spark._jsc.hadoopConfiguration())

    def rows(self, name: str, workspace_id: str, files: DataFrame) -> DataFrame:
        """Rows of the versions that ``files`` (workspace_id, source_file, version) name."""
        spark = self.registry.spark
        at, fs = self._folder(name)
        if not fs.exists(at):
            rows = spark.createDataFrame([], STORED[name])
        else:
            rows = spark.read.schema(STORED[name]).parquet(f"{self.path}/{name}").where(F.col("workspace_id") == workspace_id)
        return rows.join(files, ["workspace_id", "source_file", "version"], "left_semi")

    def _current(self, name: str, workspace_id: str) -> DataFrame:
        files = self.registry.table("chunk_file").where(F.col("workspace_id") == workspace_id).select("workspace_id", "source_file", "version")
        return self.rows(name, workspace_id, files).drop("version")

    def parents(self, workspace_id: str) -> DataFrame:
        return self._current("parents", workspace_id)

    def children(self, workspace_id: str) -> DataFrame:
        return self._current("children", workspace_id)

    def write(self, parents: DataFrame, children: DataFrame, version: str) -> DataFrame:
        """Store rows as ``version``, which nothing points to yet: id, workspace_id, source_file, version of the files that
        have rows, for :meth:`switched`."""
        for name, df in (("parents", parents), ("children", children)):
            if name == "children" and "dense" not in df.columns:
                df = df.withColumn("dense", F.lit(None).cast("array<float>"))
            df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("workspace_id", "version").parquet(f"{self.path}/{name}")
        rows = self.registry.spark.read.schema(STORED["parents"]).parquet(f"{self.path}/parents").where(F.col("version") == version)
        files = rows.select("workspace_id", "source_file", "version").distinct()
        return files.select(F.sha2(F.concat_ws("\0", "workspace_id", "source_file"), 256).alias("id"), "workspace_id", "source_file", "version")

    def switched(self, known: DataFrame, touched: DataFrame, files: DataFrame) -> DataFrame:
        """The registry's ``chunk_file`` once the ``touched`` files (workspace_id, source_file) have the rows that ``files``
        names, and no others."""
        left = known.join(touched.select("workspace_id", "source_file").distinct(), ["workspace_id", "source_file"], "left_anti")
        return left.select(*TABLES["chunk_file"].names).unionByName(files.select(*TABLES["chunk_file"].names))

    def vacuum(self) -> int:
        """Delete the versions that no file is in and no open sync may be writing; how many folders went."""
        tables = self.registry.tables()
        used = {(r.workspace_id, r.version) for r in tables["chunk_file"].select("workspace_id", "version").distinct().toLocalIterator()}
        writing = {(r.workspace_id, r.id) for r in tables["sync_run"].where("finished_at is null").select("workspace_id", "id").toLocalIterator()}
        unescape, gone = self.registry.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName, 0
        for name in STORED:
            at, fs = self._folder(name)
            for folder in fs.globStatus(self.registry.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/workspace_id=*/version=*")) or []:
                path = folder.getPath()
                key = tuple(unescape(p.getName().partition("=")[2]) for p in (path.getParent(), path))
                if key not in used and (key[0], key[1].partition(".")[0]) not in writing:
                    fs.delete(path, True)
                    gone += 1
        return gone


class SyncCancelled(RegistryError):
    """The run was asked to stop. What it had committed stays."""


@dataclass
class Course:
    """How a run reports where it is, and learns that it has to stop. ``wave`` files are committed together; None: all."""

    wave: int | None = None
    report: Callable[[str, int, int], None] = lambda state, done, total: None
    cancelled: Callable[[], bool] = lambda: False

    def check(self) -> None:
        if self.cancelled():
            raise SyncCancelled("the sync was cancelled")


def open_run(registry: Registry, workspace_id: str, settings: Settings | None = None) -> str:
    """The id of a new open run. Refused while another one of the workspace is alive; those that died are closed."""
    registry.get_workspace(workspace_id)
    run_id, started = str(uuid.uuid4()), now()
    with registry.transaction() as draft:
        alive, dead = registry.open_runs(draft["sync_run"], workspace_id, settings)
        if alive:
            raise SyncInProgress(f"a sync of {workspace_id} is under way")
        for one in dead:
            draft["sync_run"] = _closed(draft, one)
        registry.run_lease(run_id)
        draft.add("sync_run", registry._rows("sync_run", [{"id": run_id, "workspace_id": workspace_id, "started_at": started, **dict.fromkeys(evaluate.RESULTS, 0)}]))
    return run_id


def _closed(draft, run_id: str) -> DataFrame:
    """The runs once one is closed, with the numbers of the items that it has."""
    counts = evaluate.run_counters(draft["sync_item"].where(F.col("sync_run_id") == run_id)).select(F.col("sync_run_id").alias("id"), *[F.col(r).alias(f"_{r}") for r in evaluate.RESULTS])
    own, run = F.col("id") == run_id, draft["sync_run"].join(counts, "id", "left")
    run = run.withColumn("finished_at", F.when(own, F.lit(now())).otherwise(F.col("finished_at")))
    for r in evaluate.RESULTS:
        run = run.withColumn(r, F.when(own, F.coalesce(f"_{r}", F.lit(0))).otherwise(F.col(r)))
    return run.select(*TABLES["sync_run"].names)


def sync(registry: Registry, store: ChunkStore, workspace_id: str, encoder=None, settings: Settings = Settings(), readers=READERS, index=None) -> str:
    """Run one sync and give its id. Files whose bytes didn't change are neither converted nor segmented again. A second
    sync of a workspace while one is under way is refused. :mod:`lodestrata.operators.jobs` runs one in the background.
    An ``index`` (:class:`lodestrata.operators.upkeep.LiveIndex`) then catches up; if that fails, the next sync does it."""
    run_id = open_run(registry, workspace_id, settings)
    run(registry, store, workspace_id, run_id, encoder, settings, readers)
    if index is not None:
        index.update(workspace_id)
    return run_id


def run(registry: Registry, store: ChunkStore, workspace_id: str, run_id: str, encoder=None, settings: Settings = Settings(), readers=READERS, course: Course = Course()) -> None:
    """Work at an open run until it is closed, in whatever way."""
    folder = registry.get_workspace(workspace_id)["folder_path"]
    with registry.run_lease(run_id):
        try:
            _sync(registry, store, registry.spark, workspace_id, folder, run_id, encoder, settings, readers, course)
        except BaseException:
            with registry.transaction() as draft:  # a run that failed isn't left open
                draft["sync_run"] = _closed(draft, run_id)
            raise


def _sync(registry, store, spark, workspace_id, folder, run_id, encoder, settings, readers, course) -> None:
    scan = scan_folder(spark, folder, settings)  # a stored table
    known = registry.table("document").where(F.col("workspace_id") == workspace_id)
    changes = stored(diff.detect_changes(scan, known), "changes")
    fresh = F.col("change").isin(diff.NEW, diff.CHANGED)
    todo = placed(changes.where(fresh).join(scan.select("file_name", "path"), "file_name"), ("file_name",), name="_ord")
    total = todo.count()
    waves = max(1, -(-total // course.wave)) if course.wave else 1
    course.report("scanned", 0, total)
    for k in range(waves):
        course.check()
        last = k == waves - 1
        part = todo.where(F.floor(F.col("_ord") / course.wave) == k) if course.wave else todo
        mine = changes.where(fresh).join(part.select("file_name"), "file_name", "left_semi")
        if last:
            mine = mine.unionByName(changes.where(~fresh))
        _wave(registry, store, workspace_id, run_id, scan, known, part, mine, encoder, settings, readers, f"{run_id}.{k}", last)
        course.report("stored", min((k + 1) * course.wave, total) if course.wave else total, total)


def _wave(registry, store, workspace_id, run_id, scan, known, todo, changes, encoder, settings, readers, version, last) -> None:
    """Convert and store some of a run's files, and commit them; with the ``last``, all that needs no reading, and the run."""
    converted = stored(convert_files(todo.select("file_name", "path"), settings, readers), "converted")
    results = stored(diff.sync_results(changes, converted), "results")

    good = converted.where("outcome = 'converted'").select(F.lit(workspace_id).alias("workspace_id"), F.col("file_name").alias("source_file"), "markdown")
    parents, children = segment.chunk(good, settings)
    if encoder is not None:
        children = embed.embed_children(children.where("text rlike '(?U)[^\\\\s]'"), encoder, "sync", settings)
    files = store.write(parents, children, version)

    status = F.when(F.col("result").isin("failed", "skipped", "removed"), F.col("result")).otherwise("active")
    touched = results.where("result <> 'unchanged'").join(converted.select("file_name", "page_count"), "file_name", "left").join(known.select(F.col("id").alias("document_id"), F.col("content_hash").alias("_hash"), F.col("page_count").alias("_pages")), "document_id", "left")
    fresh = touched.select(
        F.coalesce("document_id", F.expr("uuid()")).alias("id"), F.lit(workspace_id).alias("workspace_id"), "file_name", "file_type",
        F.when(F.col("digest").isNotNull(), pack_fingerprint(F.col("digest"), F.col("size_bytes"))).otherwise(F.coalesce("_hash", F.lit(""))).alias("content_hash"),
        F.coalesce("page_count", "_pages").alias("page_count"), status.alias("status"), F.lit(now()).alias("last_synced_at"),
    )
    fresh = stored(fresh, "fresh")
    ids = fresh.select("file_name", F.col("id").alias("_id"))
    rows = results.select("file_name", "result", "reason", "document_id")
    if last:
        none = F.lit(None).cast("string").alias("document_id")
        rows = rows.unionByName(scan.where(F.col("scan_state") == diff.UNREADABLE).select("file_name", F.lit("failed").alias("result"), "reason", none))
        rows = rows.unionByName(scan.where(F.col("scan_state") == diff.UNSUPPORTED).join(changes.select("file_name"), "file_name", "left_anti").select("file_name", F.lit("skipped").alias("result"), "reason", none))
    rows = rows.join(ids, "file_name", "left")
    items = stored(rows.select(F.expr("uuid()").alias("id"), F.lit(run_id).alias("sync_run_id"), F.coalesce("document_id", "_id").alias("document_id"), "file_name", "result", "reason").select(*TABLES["sync_item"].names), "items")
    with registry.transaction() as draft:
        draft["document"] = upserted(draft["document"], fresh)
        draft.add("sync_item", items)
        moved = results.where("result <> 'unchanged'").select(F.lit(workspace_id).alias("workspace_id"), F.col("file_name").alias("source_file"))
        draft["chunk_file"] = store.switched(draft["chunk_file"], moved, files)
        if last:
            draft["sync_run"] = _closed(draft, run_id)
