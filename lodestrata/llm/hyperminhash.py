"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Each shingle's hash picks one of 256 buckets by its leading bits;
a bucket keeps the least remaining hash, compressed to its number of leading zeros and ten mantissa bits (16 bits a
bucket). Empty buckets borrow from full ones by a seeded probe order, so that short texts band as well as long ones.

1. Signatures: one pass over the texts. Documents with equal sets collapse into one class (128-bit set hash, partial
   aggregation), so groups of copies cost one row from here on.
2. Banding: 42 bands of 6 compressed registers. Classes at similarity 0.8 share no band with probability 3e-6.
3. Stars: in each bucket every class is paired with the bucket's leader, the class that meets most others in all its
   buckets (what a group of near copies was made from, as it is nearer to each copy than they are to each other). A pair's similarity is estimated from the
   registers, corrected for compressed registers that agree by chance; pairs that could still reach the threshold
   (five standard errors) are confirmed on the full sets.
4. Completion: buckets that still hold several components are joined to families. In a family all documents outside its
   largest component meet all of it in blocks of bounded size, by their registers: pairs of different components that
   sizes and registers don't rule out are confirmed as in step 3. A block with more such pairs than ``DENSE`` a document
   doesn't send them on: its full sets are compared in place, by exact intersection counts, and it gives only links that
   connect components. Nothing is capped. Work grows with the square of what is left apart in a family.
5. Components of the confirmed links, mapped back to all documents.

Sets are sets of 64-bit shingle hashes (words of over 256 bytes are hashed by BLAKE2, others by polynomials), equal sets
those with equal 128-bit hashes and sizes.

Null, empty and white-space texts have an empty set and link with nothing. Rows that repeat a doc_id are one document if
their texts are equal; else each text links by itself, and what they link with is one component. A row without a doc_id is
a document for each text and comes after all others: its component_id is the smallest doc_id it reaches, null if it reaches
none, and it is kept if no other document of its component comes before it. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, free_name, frugal, mixed, numbered_texts, record_batch, scratch, shingle_hashes, slabs, stored, table, tune, utf8, word_hashes
from .components import components

_U = np.uint64
BUCKETS, BANDS, ROWS, MANTISSA = 256, 42, 6, 10
#: Completion: documents of a block, pairs for each of them that a block may send on, and columns of a membership matrix.
BLOCK, DENSE, COLUMNS = 512, 16, 2048
#: Pairs or ids (sixteen bytes at most) that may be broadcast to find their texts.
FEW_IDS = 1 << 20
#: Probability that two different values of a bucket compress to the same register: they need equal leading zeros (1/3)
#: and equal mantissas.
COLLISION = 1 / 3 / (1 << MANTISSA)


def shingle_sets(texts: list[bytes], width: int):
    """The sorted distinct shingle hashes of each text (UTF-8), in order."""
    for slab in slabs(texts, len):
        words, counts = word_hashes(slab)
        at = 0
        for n in counts.tolist():
            yield shingle_hashes(words[at : at + n], width)
            at += n


#: The bucket that empty bucket b asks at each attempt: a fixed random table.
_PROBES = (mixed(np.arange(BUCKETS * 512, dtype=_U) + _U(77)) >> _U(56)).astype(np.int64).reshape(512, BUCKETS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 256) compressed registers; all sets must have members."""
    least = np.zeros((len(sets), BUCKETS), _U)
    full = np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        bucket = (s >> _U(56)).astype(np.int64)
        head = np.flatnonzero(np.diff(bucket, prepend=-1))
        least[i, bucket[head]] = s[head] << _U(8)
        full[i, bucket[head]] = True
    # the position of the leading one and the bits after it, as a float has them
    bits = (least | _U(1)).astype(np.float64).view(_U)
    zeros = _U(1087) - (bits >> _U(52))
    out = ((zeros << _U(MANTISSA)) | ((bits >> _U(52 - MANTISSA)) & _U((1 << MANTISSA) - 1))).astype(np.uint16)
    todo = np.flatnonzero(~full.all(1))
    have, filled = full[todo], out[todo]
    for probe in _PROBES:
        if not len(todo):
            break
        want = have[:, probe]
        empty = ~full[todo] & want
        fresh = out[todo][:, probe]
        filled[empty] = fresh[empty]
        full[todo] |= empty
        done = full[todo].all(1)
        if done.any():
            out_rows = todo[done]
            final = filled[done]
            todo, have, filled = todo[~done], have[~done], filled[~done]
            _store(out, out_rows, final)
    for i in range(len(todo)):  # a bucket that met no full one in all attempts: the next full one
        at = np.flatnonzero(have[i])
        rest = np.flatnonzero(~full[todo[i]])
        filled[i, rest] = out[todo[i]][at[np.searchsorted(at, rest) % len(at)]]
    _store(out, todo, filled)
    return out


def _store(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    out[rows] = values


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, 42) 64-bit keys of the bands; the band's number is part of the key."""
    r = regs[:, : BANDS * ROWS].astype(_U).reshape(len(regs), BANDS, ROWS)
    shift = _U(1) << (_U(16) * np.arange(3, dtype=_U))
    low, high = (r[:, :, :3] * shift).sum(2, dtype=_U), (r[:, :, 3:] * shift).sum(2, dtype=_U)
    return mixed(mixed(low + np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) ^ high).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit set hash), registers of each row."""

    def sign(batches):
        for batch in batches:
            sets = list(shingle_sets(utf8(batch["text"]), width))
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            regs: list[bytes | None] = [None] * len(sets)
            if len(some):
                for i, r in zip(some.tolist(), registers([sets[i] for i in some]), strict=True):
                    regs[i] = r.tobytes()
            a = np.array([mixed(s).sum(dtype=_U) for s in sets], _U).view(np.int64)
            b = np.array([np.bitwise_xor.reduce(mixed(s ^ _U(0xA5A5A5A5))) if len(s) else 0 for s in sets], _U).view(np.int64)
            yield record_batch(doc_id=batch["doc_id"], n_shingles=n, set_a=a, set_b=b, registers=pyarrow.array(regs, pyarrow.binary()))

    schema = "doc_id long, n_shingles long, set_a long, set_b long, registers binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(sign), schema)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from registers, less what compressed registers agree on by chance."""
    agree = (a == b).mean(1)
    return np.clip((agree - COLLISION) / (1 - COLLISION), 0, 1)


def _within_reach(agreement: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether estimates and sizes leave the threshold possible, by five standard errors."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    # short sets fill few buckets, so borrowed registers repeat and tell less
    error = np.sqrt(least * (1 - least) / np.minimum(BUCKETS, small) * 2)
    return (agreement >= least - 5 * error) & (small >= (least - 1e-9) * large)


def _possible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sizes and registers don't rule the threshold out."""

    def sift(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                na, nb = (batch[c].to_numpy().astype(np.float64) for c in ("na", "nb"))
                yield batch.select(["a", "b"]).filter(pyarrow.array(_within_reach(estimated(a, b), na, nb, least)))

    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.lit(least - 1e-9) * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(frugal(sift), "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, repeats: bool, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union. ``repeats``: whether ``docs`` may repeat rows."""

    def compare(batches):
        for batch in batches:
            left, right = shingle_sets(utf8(batch["ta"]), width), shingle_sets(utf8(batch["tb"]), width)
            good = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield batch.select(["a", "b"]).filter(pyarrow.array(good, pyarrow.bool_()))

    # links come as a star: many b to each a. Texts of b meet their pairs where they lie, those of a are shuffled to them
    pairs = stored(pairs, "pairs")
    few = F.broadcast if pairs.count() <= FEW_IDS else lambda df: df
    texts = docs.select("doc_id", "text")
    if few is not F.broadcast:  # one shuffle of all texts leaves those that matter
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = stored(texts.join(ids, "doc_id", "left_semi"), "texts")
    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).join(few(pairs), "b")
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).join(few(pairs.select("a").distinct()), "a", "left_semi")
    if repeats:
        of_b, of_a = of_b.dropDuplicates(["a", "b"]), of_a.dropDuplicates(["a"])
    return stored(of_b.join(of_a, "a").select("a", "b", "ta", "tb").mapInArrow(frugal(compare), "a long, b long"), "confirmed")


def _completed(shared: DataFrame, groups: DataFrame, classes: DataFrame, docs: DataFrame, repeats: bool, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket: as many as connect what the links at hand leave
    apart, out of all that there are. See step 4."""
    placed = shared.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    open_keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("first")).where("lo < hi").select("key", "first")
    open_ = stored(placed.join(open_keys, "key"), "open")
    family = components(open_.select(F.col("first").alias("a"), F.col("id").alias("b")).union(open_.select("id", "c")))
    row = stored(open_.select("id", "c").distinct().join(family, "id").select(F.col("component").alias("family"), "id", "c"), "family")
    parts = row.groupBy("family", "c").agg(F.count("*").alias("n"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    main = parts.groupBy("family").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all"))
    main = stored(main.select("family", F.col("m.c").alias("main"), blocks(F.col("all")).alias("n_all"), blocks(F.col("all") - F.col("m.n")).alias("n_rest")), "main")
    row = row.join(main, "family")
    pick = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    as_every = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda i: F.struct(i.alias("rest"), pick(F.col("n_all")).alias("every"), F.lit(1).alias("side")))
    as_rest = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda i: F.struct(pick(F.col("n_rest")).alias("rest"), i.alias("every"), F.lit(0).alias("side")))
    sent = row.withColumn("t", F.explode(F.concat(as_every, F.when(F.col("c") == F.col("main"), F.slice(as_rest, 1, 0)).otherwise(as_rest)))).select("id", "c", "family", "t.*")
    least, keys = percent / 100, ["family", "rest", "every"]

    def sift(rows: pyarrow.Table) -> pyarrow.Table:
        ids, c, side, size = (rows[k].to_numpy() for k in ("id", "c", "side", "n_shingles"))
        regs = np.frombuffer(b"".join(rows["registers"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        y = np.flatnonzero(side == 1)
        y = y[np.argsort(size[y], kind="stable")]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(side == 0):
            near = y[slice(*np.searchsorted(size[y], ((least - 1e-9) * size[i], size[i] / (least - 1e-9) + 1)))]
            near = near[c[near] != c[i]]
            near = near[_within_reach(estimated(regs[near], regs[i]), size[near], size[i], least)]
            a.append(np.minimum(ids[near], ids[i]))
            b.append(np.maximum(ids[near], ids[i]))
        a, b = np.concatenate(a), np.concatenate(b)
        if dense := len(a) > DENSE * len(ids):
            a, b = a[:1], b[:1]
        where = {k: np.repeat(rows[k].to_numpy()[:1], len(a)) for k in keys}
        return pyarrow.table({"a": a, "b": b, **where, "dense": np.full(len(a), dense)})

    met = sent.join(classes.select("id", "n_shingles", "registers"), "id").groupBy(*keys).applyInArrow(sift, "a long, b long, family long, rest int, every int, dense boolean")
    met = stored(met, "met")
    links = _confirmed(met.where("not dense").select("a", "b").distinct(), docs, repeats, width, percent)
    crowded = met.where("dense").select(*keys)
    if crowded.isEmpty():
        return links
    sent = sent.join(crowded, keys, "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sent.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    return links.union(stored(_compared_in_place(sent.join(texts, "id"), width, percent), "completed"))


def _compared_in_place(tasks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect components within each block of ``tasks`` (id, c, family, side, rest, every, text)."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        sets = list(shingle_sets([as_bytes(t) for t in rows["text"]], width))
        ids, c, side = (rows[k].to_numpy() for k in ("id", "c", "side"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = intersections([sets[i] for i in x], [sets[i] for i in y])
        size = np.array([len(s) for s in sets])
        union = size[x][:, None] + size[y][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (c[x][:, None] != c[y][None, :]))
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while root.get(k, k) != k:
                root[k] = k = root.get(root[k], root[k])
            return k

        out = []
        for u, v in zip(x[i].tolist(), y[j].tolist(), strict=True):
            p, q = find(int(c[u])), find(int(c[v]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(ids[u]), int(ids[v])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return tasks.groupBy("family", "rest", "every").applyInPandas(compare, "a long, b long")


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``, as products of membership matrices over the
    members that both sides have."""
    out = np.zeros((len(x), len(y)), np.float32)
    if not x or not y:
        return out.astype(np.int64)
    flat = [np.concatenate(s) for s in (x, y)]
    owner = [np.repeat(np.arange(len(s)), [len(e) for e in s]) for s in (x, y)]
    names = np.intersect1d(*flat)
    code = []
    for k in (0, 1):
        at = np.searchsorted(names, flat[k])
        hit = (at < len(names)) & (names[np.minimum(at, max(len(names) - 1, 0))] == flat[k]) if len(names) else np.zeros(len(at), bool)
        order = np.argsort(at[hit], kind="stable")
        code.append((at[hit][order], owner[k][hit][order]))
    for low in range(0, len(names), COLUMNS):
        part = []
        for k, n in ((0, len(x)), (1, len(y))):
            a, b = np.searchsorted(code[k][0], (low, low + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[code[k][1][a:b], code[k][0][a:b] - low] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _components_of_texts(docs: DataFrame, owners: DataFrame | None, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text; a doc_id has one text) -> (doc_id, n_shingles) of each row, and (doc_id, component) of those
    with a set. ``owners`` (doc_id, owner) says which doc_ids belong together."""
    least = percent / 100
    signed = stored(signatures(docs, width), "signatures")
    repeats = not signed.groupBy("doc_id").count().where("count > 1").isEmpty()
    full = signed.where("n_shingles > 0")
    # equal sets are one class, with partial sums before the shuffle
    keys = ["set_a", "set_b", "n_shingles"]
    grouped = full.groupBy(*keys).agg(F.min(F.struct("doc_id", "registers")).alias("m"), F.max("doc_id").alias("last"))
    classes = stored(grouped.select(*keys, F.col("m.doc_id").alias("id"), "m.registers", "last"), "classes")
    # who has company in a class: the join splits a class that holds too much
    heads = classes.where("id < last").select(*keys, F.col("id").alias("_head"))
    by_set = full.select("doc_id", *keys).join(heads, keys, "left").select("doc_id", F.coalesce("_head", "doc_id").alias("id"))

    def band(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint16).reshape(-1, BUCKETS))
                yield record_batch(id=np.repeat(batch["id"].to_numpy(), BANDS), key=keys.ravel())

    bands = classes.select("id", "registers").mapInArrow(frugal(band), "id long, key long")
    crowds = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(bands.join(crowds, "key"), "bands")  # only buckets of two classes or more
    company = shared.groupBy("id").agg(F.sum("n").alias("company"))
    leaders = shared.join(company, "id").groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("id"))).alias("m")).select("key", (-F.col("m.id")).alias("leader"))
    shared = stored(shared.join(leaders, "key"), "led")
    stars = shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(_possible(stars, classes, least), docs, repeats, width, percent)
    if owners is not None:  # the texts of a doc_id belong together
        texts = by_set.join(owners, "doc_id").select("owner", "id")
        ties = texts.join(texts.groupBy("owner").agg(F.min("id").alias("first")), "owner").where("first < id")
        links = stored(links.union(ties.select("first", "id")).distinct(), "tied")
    groups = stored(components(links), "groups")
    more = _completed(shared, groups, classes, docs, repeats, width, percent)
    if not more.isEmpty():
        groups = stored(components(links.union(more)), "groups")
    component = by_set.join(groups, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    return signed.select("doc_id", "n_shingles"), component


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession) as keep:
        numbered = numbered_texts(docs)
        if not numbered:
            sizes, component = _components_of_texts(docs, None, width, percent)
            # rows that repeat a doc_id have one component
            component = component.distinct().withColumnRenamed("component", "component_id")
            out = sizes.join(component, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
            return keep(stored(out.withColumn("kept", F.col("doc_id") == F.col("component_id")), "near"))
        # from here to the end each text of a doc_id goes by a number of its own
        rows, names = numbered
        first = names.where("doc_id is not null").groupBy("doc_id").agg(F.min("number").alias("owner"))
        owners = stored(names.join(first, "doc_id", "left").select("number", "doc_id", F.coalesce("owner", "number").alias("owner")), "owners")
        sizes, component = _components_of_texts(rows, owners.select(F.col("number").alias("doc_id"), "owner"), width, percent)
        component = component.withColumnRenamed("doc_id", "number").join(owners.select("number", "owner"), "number").groupBy("owner").agg(F.min("component").alias("component"))
        # numbers are in the order of doc_ids: the least of a component is of its least doc_id
        heads = owners.select(F.col("number").alias("component"), F.col("doc_id").alias("component_id"), F.col("owner").alias("head"))
        component = component.join(heads, "component").select("owner", "component_id", "head")
        out = sizes.withColumnRenamed("doc_id", "number").join(owners, "number").join(component, "owner", "left")
        own = F.coalesce("head", "owner") == F.col("owner")
        return keep(stored(out.select("doc_id", "n_shingles", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), own.alias("kept")), "near"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one: the row of its smallest doc_id. Of rows that repeat a
    document, with or without a doc_id, the one with the least hash stays; texts without words stay all, but once."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    numbered = numbered_texts(docs)
    rows, names = numbered or (docs, None)
    # each text of a doc_id that has several is a document of its own here
    gone = near_duplicates(rows, width, percent).where("not kept").select("doc_id").distinct()
    kept = rows.join(F.broadcast(gone) if gone.count() <= FEW_IDS else gone, "doc_id", "left_anti")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
        every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        kept = kept.groupBy(F.col("doc_id").alias("_group")).agg(F.min_by(every, F.xxhash64(*hashable)).alias("_row")).select("_row.*")
    if names is not None:
        number, name = (free_name(kept.columns, x) for x in ("_number", "_name"))
        own = names.select(F.col("number").alias(number), F.col("doc_id").alias(name))
        kept = kept.join(own, F.col("doc_id") == F.col(number)).withColumn("doc_id", F.col(name))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


#: All pairs that share a shingle; doc_ids must not repeat.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
