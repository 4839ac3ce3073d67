"""Syncs in the background: started at once, polled for progress, cancelled.

A job opens its run and then works at it in a thread of the driver that started it. Its files are committed in waves, in
order of their names, each by one transaction of the registry, so that a job that is cancelled or dies leaves whole waves:
what is committed is in registry and store, and no other file is touched. What a job reports are rows in small files beside
the registry, that any session can read; so is the wish to cancel, which every wave looks for. Where the job runs in this
very session, a cancel also ends the Spark jobs of the wave at work, by their tag.
"""

from __future__ import annotations

import json

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.settings import Settings
from lodestrata.sources.readers import READERS

from . import sync
from .registry import Registry, now

#: States that a run ends in.
ENDED = ("finished", "cancelled", "failed")
PROGRESS = "run_id string, workspace_id string, seq bigint, at timestamp, state string, done bigint, total bigint, error string"


def progress(registry: Registry) -> DataFrame:
    """What the jobs of a registry have reported: run_id, workspace_id, seq, at, state (scanned, stored, finished, cancelled,
    failed), done and total files, error."""
    folder = f"{registry.path}/progress"
    if not registry._fs.exists(registry._path(folder)):
        return registry.spark.createDataFrame([], PROGRESS)
    return registry.spark.read.schema(PROGRESS).json(f"{folder}/*.json")


def latest(registry: Registry) -> DataFrame:
    """The last report of each run."""
    by_run = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return progress(registry).withColumn("_n", F.row_number().over(by_run)).where("_n = 1").drop("_n")


def state(registry: Registry, run_id: str) -> dict | None:
    """The last report of one run; ``lost`` if it has not ended and its lease has run out. None if it never reported."""
    row = progress(registry).where(F.col("run_id") == run_id).orderBy(F.desc("seq")).first()
    if row is None:
        return None
    found = row.asDict()
    if found["state"] not in ENDED and registry.run_is_dead(run_id, found["at"]):
        found["state"] = "lost"
    return found


def cancel(registry: Registry, run_id: str) -> None:
    """Ask a run to stop, from whatever session."""
    registry._write_text(registry._path(f"{registry.path}/cancel/{run_id}"), run_id, True)
    registry.spark.sparkContext.cancelJobsWithTag(tag(run_id))


def tag(run_id: str) -> str:
    return f"lodestrata-sync-{run_id}"


class SyncJob:
    """One run in the background. ``watch(job, report)`` is called after each report, in the job's own thread."""

    def __init__(self, registry: Registry, store: sync.ChunkStore, workspace_id: str, encoder=None, settings: Settings = Settings(), readers=READERS, watch=None):
        self.registry, self.workspace_id, self.watch = registry, workspace_id, watch
        self.run_id = sync.open_run(registry, workspace_id, settings)
        self.error: BaseException | None = None
        self._seq, self._last = 0, (0, 0)
        self._asked = registry._path(f"{registry.path}/cancel/{self.run_id}")
        self._thread = InheritableThread(target=self._work, args=(store, encoder, settings, readers))
        self._thread.daemon = True
        self._thread.start()

    def _report(self, name: str, done: int, total: int, error: str | None = None) -> None:
        row = {"run_id": self.run_id, "workspace_id": self.workspace_id, "seq": self._seq, "at": now().isoformat(), "state": name, "done": done, "total": total, "error": error}
        self.registry._write_text(self.registry._path(f"{self.registry.path}/progress/{self.run_id}-{self._seq:06}.json"), json.dumps(row) + "\n", True)
        self._seq, self._last = self._seq + 1, (done, total)
        if self.watch is not None:
            self.watch(self, row)

    def _cancelled(self) -> bool:
        return bool(self.registry._fs.exists(self._asked))

    def _work(self, store, encoder, settings, readers) -> None:
        course = sync.Course(settings.wave_files, self._report, self._cancelled)
        context = self.registry.spark.sparkContext
        context.addJobTag(tag(self.run_id))
        try:
            sync.run(self.registry, store, self.workspace_id, self.run_id, encoder, settings, readers, course)
            self._report("finished", self._last[1], self._last[1])
        except BaseException as e:  # noqa: BLE001  the thread's end; the error is the caller's
            self.error = e
            stopped = isinstance(e, sync.SyncCancelled) or self._cancelled()
            self._report("cancelled" if stopped else "failed", *self._last, None if stopped else f"{type(e).__name__}: {e}"[:1000])
        finally:
            context.removeJobTag(tag(self.run_id))

    def cancel(self) -> None:
        cancel(self.registry, self.run_id)

    def wait(self, timeout: float | None = None) -> bool:
        """Whether the job ended within ``timeout`` seconds."""
        self._thread.join(timeout)
        return not self._thread.is_alive()


def start_sync(registry: Registry, store: sync.ChunkStore, workspace_id: str, encoder=None, settings: Settings = Settings(), readers=READERS, watch=None) -> SyncJob:
    """Start a sync and come back at once. Refused, like :func:`sync.sync`, while one of the workspace is under way."""
    return SyncJob(registry, store, workspace_id, encoder, settings, readers, watch)
