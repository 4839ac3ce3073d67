"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines; a line of over ``PART`` characters is cut at sentence ends into parts of about that
length, so that a text without line breaks can be compared too. The distinct 48-bit digests of the paragraphs go into a
sketch: each digest is added to one cell of each of three tables, and a cell holds the number, the exclusive-or of the
digests and the exclusive-or of their check hashes. Digests are dealt by their low bits to as many groups, a power of two, as keep eight
digests in each on average at most, and each group has 3 x 64 cells of its own, so a fingerprint's size follows the number
of paragraphs. It is written as the number of groups and the cells that hold something: ``groups|group.cell.n.digests.checks``.

Sketches of two versions subtract cell by cell, what they share cancels, and peeling recovers the digests that differ: a
cell with one digest gives it away, and taking it out of its other cells frees the next. Two fingerprints of different
sizes are compared at the smaller number of groups: the groups of the larger are added up, as cells don't depend on their
number. Where the numbers of paragraphs alone show that a fingerprint can't give back what differs, or where peeling leaves
a rest, both texts are sketched again, larger: at as many groups as both texts' paragraphs need, then with 3 x 128 cells in
each; a rest even then is settled by set difference. Likeness is common digests over all digests; two empty texts
are alike (1).

All is functions and aggregations of the engine. Texts are shuffled once, by doc_id; what a document needs of its neighbour
(a prefix, and digests) is sent to it, and cells are summed where it lies. Cost is linear in a text's length. Only pairs
that are sketched for the third time are gathered again, from the stored result.

Null texts are empty. Rows without a doc_id count as one id below all others. Rows that repeat a doc_id are fingerprinted
each, and count as one neighbour, the one with the smallest text; rows that repeat it with the same text get the same
result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

PART = 160
#: Digests that a group has on average at most, and cells of each of the three tables: of a fingerprint, and of larger sketches.
PER_GROUP, LADDER = 8, (64, 64, 128)
#: Numbers of the tables' first cells, whatever their size.
STRIDE = 128
#: A fingerprint isn't tried if numbers of paragraphs alone say that more than this differs in a group.
HOPELESS = 80

#: Multipliers of the hashes of a digest's halves, for the check and each table, from a fixed rule; the modulus is prime.
PRIME = (1 << 31) - 1
_ODD = [pow(48271, 100 + k, PRIME) for k in range(12)]

_NONE = "cast(array() as array<bigint>)"


def digests(text: Column) -> Column:
    """The distinct 48-bit digests of a text's paragraphs."""
    parts = F.regexp_extract_all(text, F.lit(r"([^\n]{1,%d}[^\n.!?]*[.!?]*)" % PART), 1)
    return F.array_distinct(F.transform(parts, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 12), 16, 10).cast("bigint")))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _hash(key: Column, which: int) -> Column:
    """31 bits: 0 is for the check, 1 to 3 are for the tables."""
    a, b, c = _ODD[3 * which : 3 * which + 3]
    return (F.shiftright(key, 24) * F.lit(a) + key.bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(b) + F.lit(c)) % F.lit(PRIME)


def check(key: Column) -> Column:
    """16 bits. What they let pass by chance leaves a rest, and so a larger try."""
    return _hash(key, 0).bitwiseAND(F.lit(0xFFFF))


def places(key: Column, rung: int) -> list[Column]:
    """The cells of ``key`` in the three tables. Each size takes bits of its own of the hashes."""
    shift = (0, 6, 12)[rung]
    return [(F.shiftright(_hash(key, j + 1), shift).bitwiseAND(F.lit(LADDER[rung] - 1)) + j * STRIDE).cast("int") for j in range(3)]


def groups_of(n: Column) -> Column:
    """How many groups ``n`` digests are dealt to: the least power of two that leaves ``PER_GROUP`` to each on average."""
    most = F.ceil(n / PER_GROUP).cast("bigint")
    return F.when(most <= 1, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(most - 1))).cast("bigint"))


def _folded(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, c: s.bitwiseXOR(c[field]))


def peeled(cells: Column, rung: int, rounds: int = 12) -> Column:
    """array<struct<s, k>>: the digests (s: 1 of the first side, -1 of the second) that the cells (cell, n, k, h; empty ones
    left out) of a group's subtracted sketches hold, or null if peeling leaves a rest."""
    single = lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (check(c["k"]) == c["h"])
    pure = lambda cs: F.array_distinct(F.transform(F.filter(cs, single), lambda c: F.struct(c["n"].alias("s"), c["k"].alias("k"), c["h"].alias("h"))))
    shown = lambda ps: F.transform(ps, lambda p: F.struct(p["s"].alias("s"), p["k"].alias("k")))

    def without(cs: Column, ps: Column) -> Column:
        placed = F.transform(ps, lambda p: F.struct(p["s"].alias("s"), p["k"].alias("k"), p["h"].alias("h"), F.array(*places(p["k"], rung)).alias("c")))
        take = lambda c, p: F.struct(c["cell"].alias("cell"), (c["n"] - p["s"]).alias("n"), c["k"].bitwiseXOR(p["k"]).alias("k"), c["h"].bitwiseXOR(p["h"]).alias("h"))
        left = _let(placed, lambda qs: F.transform(cs, lambda c: F.aggregate(F.filter(qs, lambda q: F.array_contains(q["c"], c["cell"])), c, take)))
        return F.filter(left, lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))

    def step(s: Column, _: Column) -> Column:
        some = lambda ps: F.when(F.size(ps) == 0, s).otherwise(F.struct(without(s["cells"], ps).alias("cells"), F.concat(s["got"], shown(ps)).alias("got")))
        return F.when(F.size(s["cells"]) == 0, s).otherwise(_let(pure(s["cells"]), some))

    def all_rounds(cs: Column, ps: Column) -> Column:
        last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(without(cs, ps).alias("cells"), shown(ps).alias("got")), step)
        return _let(last, lambda s: F.when(F.size(s["cells"]) == 0, s["got"]))

    def first_round(cs: Column, ps: Column) -> Column:
        # what the first table holds in sum says whether the digests found are all
        own = F.filter(cs, lambda c: c["cell"] < STRIDE)
        total = F.aggregate(own, F.lit(0).cast("bigint"), lambda n, c: n + c["n"]) == F.aggregate(ps, F.lit(0).cast("bigint"), lambda n, p: n + p["s"])
        whole = total & (_folded(own, "k") == _folded(ps, "k")) & (_folded(own, "h") == _folded(ps, "h"))
        return F.when(whole, shown(ps)).otherwise(F.when(F.size(ps) > 0, all_rounds(cs, ps)))

    return _let(cells, lambda cs: _let(pure(cs), lambda ps: first_round(cs, ps)))


def _cells(sides: DataFrame, keys: list[str], rungs: dict[int, int]) -> DataFrame:
    """``sides`` (keys, part, side 0 or 1, groups, digests) -> a row for each group that holds something: keys, part,
    grp, cells with the numbers and exclusive-ors of both sides. ``rungs``: each part's place on the ladder."""
    of_part = lambda pick: F.coalesce(*[F.when(F.col("part") == part, F.array(*pick(rung))) for part, rung in rungs.items()])
    rows = sides.select(*keys, "part", "side", "groups", F.explode("digests").alias("k"))
    rows = rows.select(*keys, "part", "side", F.col("k").bitwiseAND(F.col("groups") - 1).alias("grp"), "k", check(F.col("k")).alias("h"), F.explode(of_part(lambda rung: places(F.col("k"), rung))).alias("cell"))
    sums = []
    for side in (0, 1):
        own = lambda x: F.when(F.col("side") == side, x).otherwise(F.lit(0).cast("bigint"))  # noqa: B023, E731
        sums += [F.sum(own(F.lit(1).cast("bigint"))).alias(f"n{side}"), F.bit_xor(own(F.col("k"))).alias(f"k{side}"), F.bit_xor(own(F.col("h"))).alias(f"h{side}")]
    cells = rows.groupBy(*keys, "part", "grp", "cell").agg(*sums)
    return cells.groupBy(*keys, "part", "grp").agg(F.collect_list(F.struct("cell", "n0", "k0", "h0", "n1", "k1", "h1")).alias("cells"))


def subtracted(cells: Column) -> Column:
    """What the sketches of both sides don't share, without empty cells."""
    every = F.transform(cells, lambda c: F.struct(c["cell"].alias("cell"), (c["n0"] - c["n1"]).alias("n"), c["k0"].bitwiseXOR(c["k1"]).alias("k"), c["h0"].bitwiseXOR(c["h1"]).alias("h")))
    return F.filter(every, lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))


def _differing(rungs: dict[int, int]) -> Column:
    """How many digests of the row's group only one side has; null if peeling leaves a rest."""
    return F.coalesce(*[F.when(F.col("part") == part, F.size(peeled(subtracted(F.col("cells")), rung))) for part, rung in rungs.items()])


def _count(side: int) -> Column:
    """Digests of one side in the row's group: all are in the first table."""
    return F.aggregate(F.filter("cells", lambda c: c["cell"] < STRIDE), F.lit(0).cast("bigint"), lambda n, c: n + c[f"n{side}"])


def _written(side: int) -> Column:
    """The group's part of a fingerprint."""
    own = F.filter(F.sort_array("cells"), lambda c: c[f"n{side}"] > 0)
    one = lambda c: F.concat_ws(".", F.col("grp").cast("string"), c["cell"].cast("string"), c[f"n{side}"].cast("string"), F.lower(F.hex(c[f"k{side}"])), F.lower(F.hex(c[f"h{side}"])))
    return F.array_join(F.transform(own, one), " ")


def likeness(all_: Column, diff: Column) -> Column:
    """Common digests over all, from the sum of both sides' numbers and the number that differ."""
    return F.when(all_ > 0, (all_ - diff) / (all_ + diff)).otherwise(F.lit(1.0))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (longest text), rows, next_id (the next in descending order, after the last the first), prev_id and prev_n
    (the document whose next this is). Ranges of ids are put in order by a task each; their ends meet in one small table."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy(F.col(key).alias("id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n"), F.count("*").alias("rows"))
    ids = stored(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ids")
    ends = ids.groupBy("part").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min_by("n", "id").alias("lo_n"))
    along, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lag("hi").over(along), F.last("hi").over(whole)).alias("below"),
        F.coalesce(F.lead("lo").over(along), F.first("lo").over(whole)).alias("above"), F.coalesce(F.lead("lo_n").over(along), F.first("lo_n").over(whole)).alias("above_n"),
    )
    inside = Window.partitionBy("part").orderBy("id")
    near = ids.withColumn("_b", F.lag("id").over(inside)).withColumn("_a", F.lead("id").over(inside)).withColumn("_n", F.lead("n").over(inside))
    # one row a range: as many as shuffle partitions
    near = near.join(F.broadcast(ends), "part")
    return stored(near.select("id", "n", "rows", F.coalesce("_b", "below").alias("next_id"), F.coalesce("_a", "above").alias("prev_id"), F.coalesce("_n", "above_n").alias("prev_n")), "near")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the numbers of
    distinct paragraphs (own, the next document's) of each row. The edited text ends in a third of the next document's beginning instead of its own last third."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if docs.where("doc_id is null").isEmpty():
        return _fingerprints(docs)
    # a struct of a null is no null: it has a place in the order, and equals itself in joins
    return _fingerprints(docs.withColumn("doc_id", F.struct("doc_id"))).withColumn("doc_id", F.col("doc_id.doc_id"))


def _with_neighbour(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with what each row needs of the next document (head, other: its digests), and whether no doc_id repeats."""
    near = neighbours(docs)
    once = near.where("rows > 1").isEmpty()
    # where ids repeat, one may hold a third of the rows: then joins are left to split it
    placed, near = (docs.repartition("doc_id"), near.hint("shuffle_hash")) if once else (docs, near)
    sent = placed.join(near, placed["doc_id"] == near["id"]).select(
        F.col("prev_id").alias("to"), F.substr("text", F.lit(1), F.floor(F.col("prev_n") / 3).cast("int")).alias("head"), digests(F.col("text")).alias("other"),
    )
    if not once:
        sent = sent.groupBy("to").agg(F.min(F.struct("head", "other")).alias("m")).select("to", "m.*")
    both = placed.join(sent.hint("shuffle_hash") if once else sent, placed["doc_id"] == sent["to"]).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("head", F.lit(1), cut))
    return both.select("doc_id", "n_chars", "text", edited.alias("edited"), "other", F.xxhash64("text").alias("row")), once


#: Parts of a document's comparisons: fingerprints (which also compare if both have as many groups), the edited text where
#: they don't, the next document by fingerprints or by larger sketches, and the third try of either.
_PRINTS, _EDITED, _NEXT, _NEXT_LARGER, _AGAIN_EDITED, _AGAIN_NEXT = range(6)
_RUNGS = {_PRINTS: 0, _EDITED: 0, _NEXT: 0, _NEXT_LARGER: 1}


def _fingerprints(docs: DataFrame) -> DataFrame:
    base, once = _with_neighbour(docs)
    sides = base if once else base.dropDuplicates(["doc_id", "row"])
    sides = sides.select("doc_id", "row", digests(F.col("text")).alias("mine"), digests(F.col("edited")).alias("edited"), "other")
    n = {x: F.size(x) for x in ("mine", "edited", "other")}
    sides = sides.select("*", *[groups_of(n[x]).alias(f"g_{x}") for x in n], groups_of(n["mine"] + n["other"]).alias("g_both"))
    uneven = F.col("g_mine") != F.col("g_edited")
    least = F.least("g_mine", "g_other")
    hopeless = F.abs(n["mine"] - n["other"]) > HOPELESS * least
    side = lambda part, which, groups, keys: F.struct(F.lit(part).alias("part") if isinstance(part, int) else part.alias("part"), F.lit(which).alias("side"), groups.alias("groups"), keys.alias("digests"))
    part, groups = F.when(hopeless, _NEXT_LARGER).otherwise(_NEXT), F.when(hopeless, F.col("g_both")).otherwise(least)
    fewer = F.least("g_mine", "g_edited")
    every = F.array(
        side(_PRINTS, 0, F.col("g_mine"), F.col("mine")), side(_PRINTS, 1, F.col("g_edited"), F.col("edited")),
        *[side(_EDITED, k, fewer, F.when(uneven, F.col(x)).otherwise(F.expr(_NONE))) for k, x in enumerate(("mine", "edited"))],
        side(part, 0, groups, F.col("mine")), side(part, 1, groups, F.col("other")),
    )
    met = _cells(sides.select("doc_id", "row", F.explode(every).alias("x")).select("doc_id", "row", "x.*"), ["doc_id", "row"], _RUNGS)
    counted = met.select("doc_id", "row", "part", "grp", _count(0).alias("n0"), _count(1).alias("n1"), _differing(_RUNGS).alias("diff"), *[F.when(F.col("part") == _PRINTS, _written(k)).alias(f"w{k}") for k in (0, 1)])
    of = lambda parts, x: F.when(F.col("part").isin(*parts), x)
    text = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(f"w{k}") != "", F.struct("grp", f"w{k}")))), lambda p: p[f"w{k}"]), " ")
    n_of = lambda parts, k: F.coalesce(F.sum(of(parts, F.col(f"n{k}"))), F.lit(0))
    folded = counted.groupBy("doc_id", "row").agg(
        n_of([_PRINTS], 0).alias("n_mine"), n_of([_PRINTS], 1).alias("n_edited"), n_of([_NEXT, _NEXT_LARGER], 1).alias("n_other"), text(0).alias("print_mine"), text(1).alias("print_edited"),
        *[F.coalesce(F.sum(of(parts, F.col("diff"))), F.lit(0)).alias(f"d_{p}") for p, parts in ((0, [_PRINTS]), (1, [_EDITED]), (2, [_NEXT, _NEXT_LARGER]))],
        *[F.coalesce(F.bool_or(of(parts, F.col("diff").isNull())), F.lit(False)).alias(f"f_{p}") for p, parts in ((0, [_PRINTS]), (1, [_EDITED]), (2, [_NEXT, _NEXT_LARGER]))],
    ).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    # an id that doesn't repeat is key enough: both sides lie by it already
    out = base.join(folded.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left") if once else base.join(folded, (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    uneven = groups_of(zero("n_mine")) != groups_of(zero("n_edited"))
    bad_edited, bad_next = F.coalesce(F.when(uneven, F.col("f_1")).otherwise(F.col("f_0")), F.lit(False)), F.coalesce("f_2", F.lit(False))
    written = lambda x: F.concat(groups_of(zero(f"n_{x}")).cast("string"), F.lit("|"), F.coalesce(f"print_{x}", F.lit("")))
    main = stored(out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written("mine").alias("fingerprint"), written("edited").alias("edited_fingerprint"),
        F.when(~bad_edited, likeness(zero("n_mine") + zero("n_edited"), zero(F.when(uneven, F.col("d_1")).otherwise(F.col("d_0"))))).alias("near_edited"),
        F.when(~bad_next, likeness(zero("n_mine") + zero("n_other"), zero("d_2"))).alias("near_next"),
        zero("n_mine").alias("n_paragraphs"), zero("n_other").alias("next_paragraphs"),
        F.when(bad_edited | bad_next, F.struct(digests(F.col("text")).alias("mine"), F.when(bad_edited, digests(F.col("edited"))).alias("edited"), F.when(bad_next, F.col("other")).alias("other"))).alias("again"),
    ), "prints")
    names = main.columns[:-1]
    if main.where("again is not null").isEmpty():
        return main.select(*names)
    return main.where("again is null").select(*names).union(_again(main.where("again is not null")).select(*names))


def _again(bad: DataFrame) -> DataFrame:
    """``bad`` with the likeness that is missing, from sketches larger than before; what these can't give back is settled
    by set difference."""
    bad = stored(bad.withColumn("rid", F.monotonically_increasing_id()), "again")
    pair = lambda part, other: F.struct(F.lit(part).alias("part"), F.col("again.mine").alias("mine"), F.col(f"again.{other}").alias("other"))
    pairs = bad.select("rid", F.explode(F.array(pair(_AGAIN_EDITED, "edited"), pair(_AGAIN_NEXT, "other"))).alias("p")).select("rid", "p.*").where("other is not null")
    pairs = pairs.withColumn("groups", groups_of(F.size("mine") + F.size("other")))
    sides = pairs.select("rid", "part", "groups", F.posexplode(F.array("mine", "other")).alias("side", "digests"))
    rungs = {_AGAIN_EDITED: 2, _AGAIN_NEXT: 2}
    counted = _cells(sides, ["rid"], rungs).select("rid", "part", _differing(rungs).alias("diff"))
    diff = counted.groupBy("rid", "part").agg(F.when(F.count_if(F.col("diff").isNull()) == 0, F.sum("diff")).alias("diff"))
    exact = F.size(F.array_except("mine", "other")) + F.size(F.array_except("other", "mine"))
    found = pairs.join(diff, ["rid", "part"], "left").select("rid", "part", likeness(F.size("mine") + F.size("other"), F.coalesce("diff", exact)).alias("like"))
    found = found.groupBy("rid").agg(*[F.max(F.when(F.col("part") == part, F.col("like"))).alias(name) for part, name in ((_AGAIN_EDITED, "_edited"), (_AGAIN_NEXT, "_next"))])
    joined = bad.join(found, "rid")
    return joined.withColumn("near_edited", F.coalesce("near_edited", "_edited")).withColumn("near_next", F.coalesce("near_next", "_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def _sql_hash(which: int) -> str:
    a, b, c = _ODD[3 * which : 3 * which + 3]
    return f"(((k >> 24) * {a} + (k & {(1 << 24) - 1}) * {b} + {c}) % {PRIME})"


_SQL_GROUPS = f"CAST(CASE WHEN len(%s) <= {PER_GROUP} THEN 1 ELSE pow(2, length(bin(CAST(ceil(len(%s) / {PER_GROUP}.0) AS BIGINT) - 1))) END AS BIGINT)"


def _sql_print(keys: str) -> str:
    """CTE ``print_<keys>`` (doc_id, p) of the fingerprints of a list of digests."""
    cell = lambda j: f"SELECT doc_id, k & (g - 1) AS grp, ({_sql_hash(j + 1)} & {LADDER[0] - 1}) + {j * STRIDE} AS cell, k, {_sql_hash(0)} & 65535 AS h FROM keys_{keys}"
    return f"""
keys_{keys} AS (SELECT doc_id, {_SQL_GROUPS % (keys, keys)} AS g, unnest({keys}) AS k FROM digests),
cells_{keys} AS (
  SELECT doc_id, grp, cell, count(*) AS n, bit_xor(k) AS k, bit_xor(h) AS h
  FROM ({" UNION ALL ".join(cell(j) for j in range(3))}) GROUP BY doc_id, grp, cell
),
print_{keys} AS (
  SELECT doc_id, string_agg(grp || '.' || cell || '.' || n || '.' || lower(to_hex(k)) || '.' || lower(to_hex(h)), ' ' ORDER BY grp, cell) AS p
  FROM cells_{keys} GROUP BY doc_id
)"""


def _sql_digests(text: str) -> str:
    found = r"regexp_extract_all(%s, '([^\n]{1,%d}[^\n.!?]*[.!?]*)', 1)" % (text, PART)
    return f"list_distinct(list_transform({found}, lambda p: CAST('0x' || substr(md5(p), 1, 12) AS BIGINT)))"


def _sql_like(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


#: Likeness is a set comparison here, so that the sketches' way to it is checked; doc_ids must not repeat.
ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
near AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS other FROM texts
),
edits AS (
  SELECT doc_id, text, other, substring(text, 1, CAST(length(text) - length(text) // 3 AS BIGINT)) || substring(other, 1, CAST(length(text) // 3 AS BIGINT)) AS edited FROM near
),
digests AS (
  SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
         {_sql_digests("text")} AS mine, {_sql_digests("edited")} AS edited, {_sql_digests("other")} AS nxt
  FROM edits
),{_sql_print("mine")},{_sql_print("edited")}
SELECT d.doc_id, n_chars, edited_sha256, {_SQL_GROUPS % ("d.mine", "d.mine")} || '|' || coalesce(m.p, '') AS fingerprint, {_SQL_GROUPS % ("d.edited", "d.edited")} || '|' || coalesce(e.p, '') AS edited_fingerprint,
       {_sql_like("d.mine", "d.edited")} AS near_edited, {_sql_like("d.mine", "d.nxt")} AS near_next, CAST(len(d.mine) AS BIGINT) AS n_paragraphs, CAST(len(d.nxt) AS BIGINT) AS next_paragraphs
FROM digests d LEFT JOIN print_mine m ON m.doc_id = d.doc_id LEFT JOIN print_edited e ON e.doc_id = d.doc_id
"""
