"""The registry: tables of plain rows with the constraints of a small database, kept as versioned snapshots.

A write is a transaction: it takes the lock, changes tables as DataFrames, checks the constraints that the change can
break, writes what changed, and swaps one pointer file. Rows that are only added are a new folder beside the table's old
ones, and only they are checked, so an insert costs what it brings and not what is there; after ``PARTS`` folders a table
is written anew. Readers see whole versions only. Reading never creates a registry, and a missing one is not an empty one.

The lock names its owner, who renews it while the write lasts. A writer that died leaves its lock behind: once that is older
than ``lock_expiry_s`` the next writer moves it aside, and a writer that was only cut off finds at its swap that the lock is
no longer its own, and gives up.

A sync run is open until it has a ``finished_at``. Whoever works at it renews a lease of its name; an open run whose lease
has run out, or that never had one and is older than ``run_expiry_s``, has died and stands in nobody's way.

Besides the six tables that users see, ``chunk_file`` says which version of the chunk store holds each file's rows, so that
store and registry switch by the same pointer; ``index_part`` names the parts of each workspace's block index.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import strip
from lodestrata.settings import Settings

from .lease import Lease, age


class RegistryError(Exception):
    """Any refusal of the registry."""


class RegistryNotFound(RegistryError):
    pass


class RegistryBusy(RegistryError):
    pass


class ConstraintViolation(RegistryError):
    pass


class WorkspaceNotFound(RegistryError):
    pass


class DuplicateWorkspace(RegistryError):
    pass


class InvalidWorkspaceName(RegistryError):
    pass


class InvalidFolder(RegistryError):
    pass


class SyncInProgress(RegistryError):
    """What was asked for has to wait for a sync of the workspace that is under way."""


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """'name type!, ...': an exclamation mark is NOT NULL."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


_COUNTERS = ("added", "changed", "unchanged", "failed", "removed", "skipped")
TABLES = {
    "workspace": _schema("id string!, name string!, folder_path string!, legal_flag boolean!, created_at timestamp!"),
    "document": _schema("id string!, workspace_id string!, file_name string!, file_type string!, content_hash string!, page_count int, status string!, last_synced_at timestamp"),
    "sync_run": _schema("id string!, workspace_id string!, started_at timestamp!, finished_at timestamp, " + ", ".join(f"{c} int!" for c in _COUNTERS)),
    "sync_item": _schema("id string!, sync_run_id string!, document_id string, file_name string!, result string!, reason string"),
    "eval_run": _schema("id string!, workspace_id string!, run_at timestamp!, groundedness double, relevancy double, refusal_pass int!, refusal_total int!, passed boolean!, report_path string"),
    "eval_result": _schema("id string!, eval_run_id string!, question_id string!, kind string!, groundedness double, relevancy double, passed boolean!"),
    "chunk_file": _schema("id string!, workspace_id string!, source_file string!, version string!"),
    "index_part": _schema("id string!, workspace_id string!, number int!, level int!"),
}
#: Folders that a table may consist of before it is written anew.
PARTS = 16
UNIQUE = {"workspace": [["id"], ["name"]], "document": [["id"], ["workspace_id", "file_name"]], "chunk_file": [["id"], ["workspace_id", "source_file"]], "index_part": [["id"], ["workspace_id", "number"]], **{t: [["id"]] for t in ("sync_run", "sync_item", "eval_run", "eval_result")}}
#: child table, column, parent table, and whether the child goes with its parent (else the column becomes null)
EDGES = [
    ("document", "workspace_id", "workspace", True), ("sync_run", "workspace_id", "workspace", True), ("eval_run", "workspace_id", "workspace", True),
    ("sync_item", "sync_run_id", "sync_run", True), ("eval_result", "eval_run_id", "eval_run", True), ("sync_item", "document_id", "document", False),
    ("chunk_file", "workspace_id", "workspace", True), ("index_part", "workspace_id", "workspace", True),
]
ALLOWED = {
    ("document", "status"): ("active", "failed", "skipped", "removed"), ("sync_item", "result"): _COUNTERS, ("eval_result", "kind"): ("in_scope", "out_of_scope"),
}


def violations(tables: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, changed: set[str] | None = None) -> list[str]:
    """What breaks a constraint, in words. ``changed`` names the tables to check (all by default); of those in ``added`` only
    these rows are new. One aggregation a table, one for each key, and an anti join for each reference."""
    found, added = [], added or {}
    changed = set(tables) if changed is None else changed
    for name in [t for t in tables if t in changed]:
        df, fresh = tables[name], added.get(name)
        rows = df if fresh is None else fresh
        bad = {f"{name}.{f.name} is null": F.col(f.name).isNull() for f in TABLES[name].fields if not f.nullable}
        bad |= {f"{name}.{column} is not one of {', '.join(values)}": ~F.col(column).isin(*values) for (t, column), values in ALLOWED.items() if t == name}
        counts = rows.agg(*[F.count_if(c).alias(str(k)) for k, c in enumerate(bad.values())]).first()
        found += [what for what, n in zip(bad, counts, strict=True) if n]
        for keys in UNIQUE[name]:
            # keys that come with the new rows, counted in the whole table
            own = df if fresh is None else df.join(fresh.select(*keys).distinct(), keys, "left_semi")
            if not own.groupBy(*keys).count().where("count > 1").isEmpty():
                found.append(f"{name}({', '.join(keys)}) is not unique")
    for child, column, parent, _ in EDGES:
        if child not in tables or parent not in tables:
            continue
        shrunk = parent in changed and parent not in added
        if child not in changed and not shrunk:
            continue
        rows = tables[child] if shrunk or child not in added else added[child]
        if not rows.where(F.col(column).isNotNull()).join(tables[parent].select(F.col("id").alias(column)), column, "left_anti").isEmpty():
            found.append(f"{child}.{column} points to no {parent}")
    return found


def cascaded(tables: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` after the rows of ``table`` whose ids are in ``gone`` (id) are deleted: children that belong to them go
    too, transitively, and other references to them become null."""
    out = dict(tables)
    queue = [(table, gone.select("id"))]
    while queue:
        name, ids = queue.pop(0)
        for child, column, parent, belongs in EDGES:
            if parent != name or child not in out:
                continue
            named = ids.select(F.col("id").alias(column))
            if belongs:
                queue.append((child, out[child].join(named, column, "left_semi").select("id")))
            else:
                flagged = out[child].join(named.select(column, F.lit(True).alias("_gone")), column, "left")
                kept = F.when(F.col("_gone").isNull(), F.col(column))
                out[child] = flagged.withColumn(column, kept).select(*TABLES[child].names)
        out[name] = out[name].join(ids, "id", "left_anti").select(*TABLES[name].names)
    return out


def upserted(documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """``documents`` with the rows of ``fresh`` in place of those of the same workspace and file."""
    keys = ["workspace_id", "file_name"]
    return documents.join(fresh.select(*keys), keys, "left_anti").select(*TABLES["document"].names).unionByName(fresh.select(*TABLES["document"].names))


def normal_name(name: str, settings: Settings = Settings()) -> str:
    """The name to store, trimmed; raises where its length is out of bounds."""
    trimmed = name.strip() if isinstance(name, str) else ""
    if not settings.name_min <= len(trimmed) <= settings.name_max:
        raise InvalidWorkspaceName(f"a workspace name has {settings.name_min} to {settings.name_max} characters; this one has {len(trimmed)}")
    return trimmed


def valid_names(df: DataFrame, column: str = "name", settings: Settings = Settings()) -> DataFrame:
    """``df`` with the trimmed name as ``column`` and whether it may be stored as ``valid``."""
    return df.withColumn(column, strip(column)).withColumn("valid", F.length(column).between(settings.name_min, settings.name_max))


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Draft(dict):
    """The tables of a transaction by name. Assigning one replaces it; :meth:`add` only adds rows."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__(tables)
        self.before, self._added, self._grown = dict(tables), {}, {}

    def add(self, table: str, rows: DataFrame) -> None:
        rows = rows.select(*TABLES[table].names)
        if self[table] is self._grown.get(table):
            self._added[table] = self._added[table].unionByName(rows)
        elif self[table] is self.before[table]:
            self._added[table] = rows
        self[table] = self[table].unionByName(rows)
        if table in self._added:
            self._grown[table] = self[table]

    def changed(self) -> list[str]:
        return [t for t in self if self[t] is not self.before[t]]

    def added(self, table: str) -> DataFrame | None:
        """The new rows of a table that only grew."""
        return self._added[table] if self[table] is self._grown.get(table) else None


class Registry:
    """Reads and writes of one registry folder."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # reading

    def _text(self, at) -> str:
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, at, text: str, overwrite: bool) -> None:
        out = self._fs.create(at, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _pointer(self) -> dict[str, list[str]] | None:
        at = self._path(f"{self.path}/CURRENT")
        return json.loads(self._text(at)) if self._fs.exists(at) else None

    def tables(self) -> dict[str, DataFrame]:
        pointer = self._pointer()
        if pointer is None:
            raise RegistryNotFound(f"there is no registry in {self.path}; a first write creates one")
        # a registry that an earlier release wrote has fewer tables
        return {t: self.spark.read.schema(s).parquet(*pointer[t]) if t in pointer else self.spark.createDataFrame([], s) for t, s in TABLES.items()}

    def table(self, name: str) -> DataFrame:
        return self.tables()[name]

    def list_workspaces(self) -> DataFrame:
        return self.table("workspace").orderBy("name")

    def get_workspace(self, workspace_id: str):
        row = self.table("workspace").where(F.col("id") == workspace_id).first()
        if row is None:
            raise WorkspaceNotFound(f"no workspace has the id {workspace_id}")
        return row

    def list_documents(self, workspace_id: str) -> DataFrame:
        return self.table("document").where(F.col("workspace_id") == workspace_id).orderBy("file_name")

    # writing

    def _lock(self, lock, token: str) -> None:
        began = time.monotonic()
        while True:
            try:
                self._write_text(lock, token, False)
                return
            except Exception as e:  # the file is there: another writer is at work, or died at it
                if self._stale(lock):
                    self._fs.rename(lock, self._path(f"{self.path}/LOCK.{uuid.uuid4().hex}"))
                    continue
                if time.monotonic() - began > self.settings.busy_timeout_s:
                    raise RegistryBusy(f"another write to {self.path} is under way") from e
                time.sleep(0.1)

    def _stale(self, lock) -> bool:
        old = age(self._fs, lock)  # None: it went meanwhile
        return old is not None and old > self.settings.lock_expiry_s

    # open runs

    def run_lease(self, run_id: str) -> Lease:
        """The lease of a run, made now; to be held by whoever works at it."""
        at = self._path(f"{self.path}/leases/{run_id}")
        self._write_text(at, run_id, True)
        return Lease(self._fs, at, self.settings.lease_s)

    def run_is_dead(self, run_id: str, started_at: datetime, settings: Settings | None = None) -> bool:
        settings, old = settings or self.settings, age(self._fs, self._path(f"{self.path}/leases/{run_id}"))
        if old is None:
            return started_at < now() - timedelta(seconds=settings.run_expiry_s)
        return old > settings.lease_s

    def open_runs(self, runs: DataFrame, workspace_id: str, settings: Settings | None = None) -> tuple[list[str], list[str]]:
        """The ids of a workspace's open runs, alive and dead. There is one alive at most, and few died unnoticed."""
        rows = runs.where((F.col("workspace_id") == workspace_id) & F.col("finished_at").isNull()).select("id", "started_at").collect()
        dead = [r.id for r in rows if self.run_is_dead(r.id, r.started_at, settings)]
        return [r.id for r in rows if r.id not in dead], dead

    def _owns(self, lock, token: str) -> bool:
        return bool(self._fs.exists(lock)) and self._text(lock) == token

    @contextmanager
    def transaction(self):
        """A :class:`Draft` to change in place; all changes are stored on success, none on an error."""
        lock, token = self._path(f"{self.path}/LOCK"), uuid.uuid4().hex
        self._lock(lock, token)
        made: list[str] = []
        try:
            pointer = self._pointer()
            draft = Draft(self.tables() if pointer else {t: self.spark.createDataFrame([], s) for t, s in TABLES.items()})
            with Lease(self._fs, lock, self.settings.lock_expiry_s, lambda: self._owns(lock, token)):
                yield draft
                changed = list(dict.fromkeys([*draft.changed(), *[t for t in TABLES if t not in (pointer or {})]])) if draft.changed() or pointer is None else []
                if changed:
                    self._store(draft, changed, dict(pointer or {}), made, lambda: self._owns(lock, token))
        except BaseException:
            for path in made:
                self._fs.delete(self._path(path), True)
            raise
        finally:
            if self._owns(lock, token):
                self._fs.delete(lock, False)

    def _store(self, draft: Draft, changed: list[str], pointer: dict[str, list[str]], made: list[str], owner) -> None:
        version, added = uuid.uuid4().hex, {}
        read = lambda t, paths: self.spark.read.schema(TABLES[t]).parquet(*paths)
        for t in changed:
            path, rows = f"{self.path}/{t}/{version}", draft.added(t)
            grows = rows is not None and t in pointer and len(pointer[t]) < PARTS
            made.append(path)
            (rows if grows else draft[t]).select(*TABLES[t].names).hint("rebalance").write.parquet(path)
            if grows:
                added[t] = read(t, [path])
            pointer[t] = [*pointer[t], path] if grows else [path]
        # tables that are only created now are empty
        found = violations({t: read(t, pointer[t]) for t in TABLES}, added, set(draft.changed()))
        if found:
            raise ConstraintViolation("; ".join(found))
        if not owner():
            raise RegistryBusy(f"this write to {self.path} took so long that another one began")
        self._swap(pointer)

    def _swap(self, pointer: dict[str, list[str]]) -> None:
        fresh, at = self._path(f"{self.path}/CURRENT.{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT")
        self._write_text(fresh, json.dumps(pointer), True)
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[1]
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, at, options)

    def _rows(self, table: str, rows: list[dict]) -> DataFrame:
        schema = TABLES[table]
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        return self.spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], loose)

    def _insert(self, table: str, **row) -> str:
        row["id"] = row.get("id") or str(uuid.uuid4())
        with self.transaction() as draft:
            draft.add(table, self._rows(table, [row]))
        return row["id"]

    def create_workspace(self, name: str, folder_path: str, legal_flag: bool = False) -> str:
        name = normal_name(name, self.settings)
        if isinstance(folder_path, str) and len(folder_path.strip()) < self.settings.folder_min:
            raise InvalidFolder("a workspace needs a folder")
        with self.transaction() as draft:
            if not draft["workspace"].where(F.col("name") == name).isEmpty():
                raise DuplicateWorkspace(f"there is a workspace called {name}")
            row = {"id": str(uuid.uuid4()), "name": name, "folder_path": folder_path, "legal_flag": legal_flag, "created_at": now()}
            draft.add("workspace", self._rows("workspace", [row]))
        return row["id"]

    def _update_workspace(self, workspace_id: str, column: str, value) -> None:
        own = F.col("id") == workspace_id
        with self.transaction() as draft:
            row = draft["workspace"].where(own).first()
            if row is None:
                raise WorkspaceNotFound(f"no workspace has the id {workspace_id}")
            if row[column] == value:
                return
            if column == "name" and not draft["workspace"].where((F.col("name") == value) & ~own).isEmpty():
                raise DuplicateWorkspace(f"there is a workspace called {value}")
            draft["workspace"] = draft["workspace"].withColumn(column, F.when(own, F.lit(value)).otherwise(F.col(column)))

    def rename_workspace(self, workspace_id: str, name: str) -> None:
        self._update_workspace(workspace_id, "name", normal_name(name, self.settings))

    def set_legal_flag(self, workspace_id: str, flag: bool) -> None:
        self._update_workspace(workspace_id, "legal_flag", flag)

    def _delete(self, table: str, id_: str) -> None:
        with self.transaction() as draft:
            gone = draft[table].where(F.col("id") == id_).select("id")
            if table == "workspace" and gone.isEmpty():
                raise WorkspaceNotFound(f"no workspace has the id {id_}")
            if table == "workspace" and self.open_runs(draft["sync_run"], id_)[0]:
                raise SyncInProgress(f"a sync of {id_} is under way; it has to end, or be cancelled, before the workspace can go")
            draft.update(cascaded(draft, table, gone))

    def delete_workspace(self, workspace_id: str) -> None:
        """With all that belongs to it; files on disk stay. Refused while a sync of it is under way."""
        self._delete("workspace", workspace_id)

    def delete_document(self, document_id: str) -> None:
        """Its history stays, without the reference."""
        self._delete("document", document_id)

    def insert_document(self, workspace_id: str, file_name: str, file_type: str, content_hash: str, status: str = "active", page_count: int | None = None, last_synced_at: datetime | None = None, id_: str | None = None) -> str:
        return self._insert("document", id=id_, workspace_id=workspace_id, file_name=file_name, file_type=file_type, content_hash=content_hash, status=status, page_count=page_count, last_synced_at=last_synced_at)

    def insert_sync_run(self, workspace_id: str, started_at: datetime | None = None, finished_at: datetime | None = None, id_: str | None = None, **counters: int) -> str:
        return self._insert("sync_run", id=id_, workspace_id=workspace_id, started_at=started_at or now(), finished_at=finished_at, **{c: counters.get(c, 0) for c in _COUNTERS})

    def insert_sync_item(self, sync_run_id: str, file_name: str, result: str, document_id: str | None = None, reason: str | None = None, id_: str | None = None) -> str:
        return self._insert("sync_item", id=id_, sync_run_id=sync_run_id, file_name=file_name, result=result, document_id=document_id, reason=reason)

    def insert_eval_run(self, workspace_id: str, passed: bool, groundedness: float | None = None, relevancy: float | None = None, refusal_pass: int = 0, refusal_total: int = 0, report_path: str | None = None, run_at: datetime | None = None, id_: str | None = None) -> str:
        return self._insert("eval_run", id=id_, workspace_id=workspace_id, run_at=run_at or now(), groundedness=groundedness, relevancy=relevancy, refusal_pass=refusal_pass, refusal_total=refusal_total, passed=passed, report_path=report_path)

    def insert_eval_result(self, eval_run_id: str, question_id: str, kind: str, passed: bool, groundedness: float | None = None, relevancy: float | None = None, id_: str | None = None) -> str:
        return self._insert("eval_result", id=id_, eval_run_id=eval_run_id, question_id=question_id, kind=kind, passed=passed, groundedness=groundedness, relevancy=relevancy)
