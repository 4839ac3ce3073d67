"""A block index that follows a chunk store: each catch-up writes what changed, and parts merge by levels.

The index of a workspace is a few parts; the registry's ``index_part`` names them, so readers see one whole state. A part is
a folder of

* ``chunks``: the chunks it brought, with their tokens, the file and the file's version,
* ``lists``: their postings by blocks, as in :mod:`impacts`,
* ``dead``: chunks of other parts that it makes void (tombstones),
* ``df`` and ``sizes``: by how much it changes the terms' document frequencies, and the chunks' number and length. What it
  makes void counts negative, so the sums over all parts are those of the live chunks.

A catch-up compares the files' versions in the registry with those in the index: one that died, or that never ran, leaves
nothing to repair. Its own part has level 0. ``fanout`` parts of one level become one of the next, without what is void, so
that there are fewer than ``fanout`` parts a level, and levels grow with the logarithm of the catch-ups. Once more chunks
are void than live all parts become one. Merging reads the parts' own tokens, no texts.

Replaced parts stay for those who still read them, marked as retired, until :meth:`LiveIndex.vacuum`. A workspace without
chunks has an empty index. Null texts have no terms and no length, but count as chunks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.storage import stored

from . import impacts, retrieve
from .lease import age
from .registry import Registry, RegistryBusy
from .sync import ChunkStore

FANOUT, RETIRED = 4, -1
#: A block's number starts with its part's.
_PART = 1 << 32
PART = {
    "chunks": "workspace_id string, part int, source_file string, version string, chunk_id string, length int, t string",
    "lists": f"workspace_id string, part int, {impacts.LISTS}",
    "dead": "workspace_id string, part int, chunk_id string", "df": "workspace_id string, term string, df bigint", "sizes": "workspace_id string, n bigint, texts bigint, total bigint",
}


_DF = ["workspace_id", "term", "df"]


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "texts", "total")]


def _sizes(chunks: DataFrame) -> DataFrame:
    """Of ``chunks`` (by, workspace_id, length), each of which counts ``by`` times."""
    by, has = F.col("by"), F.col("length").isNotNull()
    rows = chunks.select("workspace_id", by.alias("n"), F.when(has, by).otherwise(0).alias("texts"), F.when(has, by * F.col("length").cast("long")).otherwise(0).alias("total"))
    return rows.groupBy("workspace_id").agg(*_sums())


def _repeat(chunks: DataFrame) -> bool:
    """Whether rows repeat a chunk_id."""
    return not chunks.groupBy("workspace_id", "chunk_id").count().where("count > 1").isEmpty()


def _counts(chunks: DataFrame, by: int) -> DataFrame:
    """``by`` for each chunk that holds a term; as in lists, rows that repeat a chunk_id and have as many terms are one."""
    if _repeat(chunks):
        chunks = chunks.groupBy("workspace_id", "chunk_id", "length").agg(F.trim(F.array_join(F.collect_list("t"), " ")).alias("t"))
    return impacts.tallied(chunks).withColumn("df", F.lit(by) * F.col("df"))


def _frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("workspace_id", "term").agg(F.sum("df").alias("df")).where("df <> 0")


@dataclass
class Part:
    id: str
    number: int
    level: int


@dataclass
class LiveIndex:
    """The index of the workspaces in ``store``, below ``path``."""

    store: ChunkStore
    path: str
    fanout: int = FANOUT
    block: int = impacts.BLOCK
    registry: Registry = field(init=False)

    def __post_init__(self):
        self.registry, self.path = self.store.registry, self.path.rstrip("/")
        if self.fanout < 2:
            raise ValueError("a level holds two parts or more before they merge")

    # reading

    def parts(self, workspace_id: str | None = None) -> list[Part]:
        """The parts in use, of one workspace or of all."""
        return [p for p in self._listed(workspace_id) if p.level != RETIRED]

    def _listed(self, workspace_id: str | None) -> list[Part]:
        rows = self.registry.table("index_part")
        if workspace_id is not None:
            rows = rows.where(F.col("workspace_id") == workspace_id)
        return [Part(r.id, r.number, r.level) for r in rows.select("id", "number", "level").collect()]  # a few a workspace

    def _read(self, parts: list[Part], what: str) -> DataFrame:
        spark = self.registry.spark
        return spark.read.schema(PART[what]).parquet(*[f"{self.path}/{p.id}/{what}" for p in parts]) if parts else spark.createDataFrame([], PART[what])

    def read(self, workspace_id: str | None = None) -> impacts.BlockIndex:
        """What :func:`impacts.top_k` searches: the live chunks as of the last catch-up."""
        parts = self.parts(workspace_id)
        sizes = self._read(parts, "sizes").groupBy("workspace_id").agg(*_sums()).where("texts > 0")
        return impacts.BlockIndex(self._read(parts, "lists"), sizes.select("workspace_id", "n", (F.col("total") / F.col("texts")).alias("mean")), self._read(parts, "df"), self._read(parts, "dead"))

    def _live(self, parts: list[Part], dead: DataFrame | None = None) -> DataFrame:
        dead = self._read(parts, "dead") if dead is None else dead
        return self._read(parts, "chunks").join(dead, ["workspace_id", "part", "chunk_id"], "left_anti")

    # writing

    def update(self, workspace_id: str) -> bool:
        """Catch up with the store; whether there was anything to do."""
        listed = self._listed(workspace_id)
        parts = [p for p in listed if p.level != RETIRED]
        number = 1 + max((p.number for p in listed), default=-1)
        files, live = self.registry.table("chunk_file").where(F.col("workspace_id") == workspace_id).select("workspace_id", "source_file", "version"), self._live(parts)
        key = ["workspace_id", "source_file", "version"]
        have = stored(live.select(*key).distinct(), "have")
        gone, fresh = stored(have.join(files, key, "left_anti"), "gone"), stored(files.join(have, key, "left_anti"), "fresh")
        if gone.isEmpty() and fresh.isEmpty():
            return False
        rows = self.store.rows("children", workspace_id, fresh)
        chunk_id = F.concat_ws("/", "parent_id", F.col("child_index").cast("string"))
        chunks = rows.select("workspace_id", F.lit(number).alias("part"), "source_file", "version", chunk_id.alias("chunk_id"), retrieve.words(F.col("text")).alias("t")).withColumn("length", retrieve.n_words(F.col("t")))
        made = [Part(uuid.uuid4().hex, number, 0)]
        self._write(made[0], "chunks", chunks)
        chunks, void = self._read(made, "chunks"), stored(live.join(gone, key, "left_semi"), "void")
        self._write(made[0], "dead", void.select("workspace_id", "part", "chunk_id"))
        together, level = self._due([*parts, made[0]])
        others = [p for p in (*parts, made[0]) if p not in together]
        if together:
            made.append(Part(uuid.uuid4().hex, number + 1, level))
        if others:  # if all become one, what lives is all that counts
            if made[0] in others:
                self._write(made[0], "lists", self._blocks(chunks, number))
            own = self._read(made[:1], "lists") if made[0] in others else _counts(chunks, 1)
            self._write(made[0], "df", _frequencies(own.select(*_DF).unionByName(_counts(void, -1))))
            self._write(made[0], "sizes", chunks.withColumn("by", F.lit(1)).select("by", "workspace_id", "length").unionByName(void.select(F.lit(-1).alias("by"), "workspace_id", "length")).transform(_sizes))
        if together:
            self._merge(together, others, made[-1])
        self._switch(workspace_id, listed, made, together)
        return True

    def _write(self, part: Part, what: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in PART[what].split(", ")]
        rows.select(*columns).to(self.registry.spark.createDataFrame([], PART[what]).schema).write.parquet(f"{self.path}/{part.id}/{what}")

    def _blocks(self, chunks: DataFrame, number: int) -> DataFrame:
        """The blocks of a part's own chunks. They are cut where the chunks are read, without moving them: any chunks may be a
        block. Only rows that repeat a chunk_id have to meet."""
        own = chunks.select("workspace_id", "chunk_id", "t")
        if not _repeat(own):
            place = F.shiftleft(F.shiftright("_at", 33), 20) + F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / self.block)
            # beyond 4096 tasks, or a million blocks in one, blocks share a number: bounds add up, and both are read
            rows = impacts.in_blocks(own.withColumn("_at", F.monotonically_increasing_id()).withColumn("block", F.pmod(place, F.lit(_PART)) + F.lit(number * _PART)))
        else:
            places = impacts.numbered(own.select("workspace_id", "chunk_id").distinct())
            rows = impacts.block_rows(own.join(places, ["workspace_id", "chunk_id"]), self.block, number * _PART)
        return rows.withColumn("part", F.lit(number))

    def _due(self, parts: list[Part]) -> tuple[list[Part], int]:
        """The parts that are to become one, and its level; none where no level is full."""
        held, void = self._read(parts, "chunks").count(), self._read(parts, "dead").select("workspace_id", "part", "chunk_id").where(F.col("part").isin([p.number for p in parts])).distinct().count()
        if len(parts) > 1 and 2 * void > held:
            return parts, max(p.level for p in parts)
        together: list[Part] = []
        level, full = 0, True
        while full:
            own = [p for p in parts if p.level == level]
            full = len(own) + bool(together) >= self.fanout
            if full:
                together, level = together + own, level + 1
        return together, level

    def _merge(self, together: list[Part], others: list[Part], into: Part) -> None:
        dead = self._read([*together, *others], "dead")
        self._write(into, "chunks", self._live(together, dead).withColumn("part", F.lit(into.number)))
        self._write(into, "lists", self._blocks(self._read([into], "chunks"), into.number))
        left = F.col("part").isin([p.number for p in others])
        self._write(into, "dead", self._read(together, "dead").where(left).distinct())
        if others:
            self._write(into, "df", _frequencies(self._read(together, "df")))
            self._write(into, "sizes", self._read(together, "sizes").groupBy("workspace_id").agg(*_sums()))
        else:
            self._write(into, "df", _frequencies(self._read([into], "lists").select(*_DF)))
            self._write(into, "sizes", _sizes(self._read([into], "chunks").withColumn("by", F.lit(1))))

    def _switch(self, workspace_id: str, listed: list[Part], made: list[Part], gone: list[Part]) -> None:
        """Point the registry to the new state, if the one it was made from is still there."""
        retired = {p.id for p in gone}
        row = lambda p: {"id": p.id, "workspace_id": workspace_id, "number": p.number, "level": RETIRED if p.id in retired else p.level}
        with self.registry.transaction() as draft:
            own = F.col("workspace_id") == workspace_id
            if {r.id for r in draft["index_part"].where(own).select("id").collect()} != {p.id for p in listed}:
                raise RegistryBusy(f"another catch-up of {workspace_id} came first")
            fresh = self.registry._rows("index_part", [row(p) for p in (*listed, *made) if p.level != RETIRED])
            kept = draft["index_part"].where(~own | (F.col("level") == RETIRED))
            draft["index_part"] = kept.unionByName(fresh)

    def vacuum(self, lost_after_s: float = 86_400.0) -> int:
        """Delete retired parts, and folders that the registry doesn't know and that are older than ``lost_after_s`` (of
        workspaces that are gone, and of catch-ups that died); how many went. No search over a replaced state, and no
        catch-up that takes so long, may be under way."""
        with self.registry.transaction() as draft:
            old = [r.id for r in draft["index_part"].where(F.col("level") == RETIRED).select("id").collect()]
            if old:
                draft["index_part"] = draft["index_part"].where(F.col("level") != RETIRED)
            known = {r.id for r in draft["index_part"].select("id").collect()}
        at = self.registry._path(self.path)
        fs = at.getFileSystem(self.registry.spark._jsc.hadoopConfiguration())
        for folder in fs.listStatus(at) if fs.exists(at) else []:  # a few a workspace
            name = folder.getPath().getName()
            if name not in known and name not in old and (age(fs, folder.getPath()) or 0) > lost_after_s:
                old.append(name)
        return sum(fs.delete(self.registry._path(f"{self.path}/{name}"), True) for name in old)
