"""Removal of repeated passages by a distributed difference-cover suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or the same document and
an earlier place). Only the first ``length`` bytes of suffixes matter, and that is what lets the sort be distributed:

1. Anchors. Each window of ``length`` bytes has an anchor, the leftmost of its least k-gram hashes. Windows of equal
   bytes have equal anchors, so the anchor's hash deals suffixes out such that equal prefixes always meet. Consecutive
   windows with one anchor place make one range. Whole texts that repeat an earlier one need no ranges.
2. Ranges whose anchor occurs nowhere else hold nothing repeated and are let go; that is most of a corpus. Of ranges
   with equal bytes only the first goes on, and the others are covered from end to end.
3. Suffix arrays. The ranges left are sorted in slabs of whole anchors by the difference-cover algorithm: sort the
   triples at two of three offsets, name them, recurse on the names until they are unique, and merge in the remaining
   suffixes. Adjacent suffixes are then compared for ``length`` equal
   bytes, and each run of equal ones keeps its first place. The ranges of an anchor with more distinct ranges than a
   slab takes are cut into their windows; equal windows then meet in an aggregation by their bytes, with partial sums,
   and not in a task of that anchor.
4. The covered places of each document become runs, and its text is cut by functions of the engine: texts pass through
   Python once, for the anchors, and on their way into the suffix arrays not at all.

What rests on hashes: whole texts are taken as equal by SHA-256 and their length; ranges by 128 bits of two mixed hashes
(of their anchor and of their bytes) and their length. Which ranges meet doesn't depend on k-gram hashes being unique, and
suffix arrays and windows compare bytes.

Null texts are empty. Rows that repeat a doc_id with the same text are one document and get the same result; with other
texts they are documents of their own, next to each other in order, and each keeps or loses what its own text says. Rows
without a doc_id come after all others, one document for each text. Texts shorter than ``length`` lose nothing. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CODES, drop_stored, free_name, frugal, mixed, numbered_texts, powers, record_batch, slabs, stored, table, tune, utf8

_U = np.uint64
LENGTH, KGRAM = 100, 32
#: Bytes of ranges that one suffix array takes, and distinct ranges of an anchor that stay in one slab.
SLAB, CROWDED = 1 << 19, 2048
#: Texts are searched for anchors in parts that share length - 1 bytes, so that places fit these many bits, and arrays
#: over a part stay small however long a text is.
PLACE_BITS, PART = 24, 1 << 18


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` (non-negative integers) in the order of their suffixes, by the difference cover {1, 2} mod 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate((text.astype(np.int64) + 1, np.zeros(3, np.int64)))
    # sampled triples: places 1 and 2 modulo 3, and place n of an empty suffix where it keeps the halves apart
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    wide = int(t.max()) + 1
    if wide < 1 << 20:
        key = (t[sample] * wide + t[sample + 1]) * wide + t[sample + 2]
        order = np.argsort(key)
        ranked = key[order]
        fresh = ranked[1:] != ranked[:-1]
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        a, b, c = (t[sample[order] + i] for i in range(3))
        fresh = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(fresh)))
    if names.max() + 1 < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # the remaining suffixes: one value, then a sampled suffix
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * (len(sample) + 2) + rank[rest + 1])]
    # merge: where each remaining suffix falls among the sampled ones of either kind
    big = len(sample) + 2
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    key_one = lambda i: t[i] * big + rank[i + 1]
    place = np.searchsorted(key_one(one), key_one(rest), "left")
    pairs = wide * wide < (1 << 62) // big
    if pairs:
        key_two = lambda i: (t[i] * wide + t[i + 1]) * big + rank[i + 2]
        at_two = np.searchsorted(key_two(two), key_two(rest), "left")
    else:
        low = np.unique(t[:n + 1] * wide + t[1 : n + 2])
        key_two = lambda i: np.searchsorted(low, t[i] * wide + t[i + 1]) * big + rank[i + 2]
        at_two = np.searchsorted(key_two(two), key_two(rest), "left")
    out = np.empty(n, np.int64)
    at_rest = np.arange(len(rest)) + place + at_two
    taken = np.zeros(n, bool)
    taken[at_rest] = True
    out[at_rest] = rest
    out[~taken] = sampled
    return out


def repeated_windows(data: np.ndarray, valid: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Places in ``data`` (bytes + 1; 0 ends a string) of windows that equal an earlier one.

    ``valid``: whether a whole window starts there; ``order``: how early it is. Adjacent suffixes are compared."""
    sa = suffix_array(data)
    sa = sa[valid[sa]]
    if len(sa) < 2:
        return sa[:0]
    same = np.zeros(len(sa), bool)  # equal to the one before
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    at = np.arange(1, len(sa))
    for i in (0, length - 1, length // 2):
        at = at[data[sa[at] + i] == data[sa[at - 1] + i]]
    for part in np.array_split(at, max(1, len(at) * length // (8 << 20))):
        same[part] = (view[sa[part]] == view[sa[part - 1]]).all(1)
    run = np.cumsum(~same) - 1
    size = np.bincount(run)
    some = size[run] > 1
    sa, run = sa[some], run[some]
    if not len(sa):
        return sa
    head = np.flatnonzero(np.diff(run, prepend=-1))
    least = np.minimum.reduceat(order[sa], head)
    return sa[order[sa] > np.repeat(least, np.diff(np.append(head, len(run))))]


def anchored_ranges(texts: list[bytes], length: int, kgram: int):
    """(text's number, start, windows, anchor hash, content hash) of all ranges of the texts, as arrays."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    if len(raw) < length:
        return [np.zeros(0, np.int64)] * 5
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(CODES[raw] * up[: len(raw)], out=sums[1:])
    n = len(raw) - kgram + 1
    grams = mixed((sums[kgram:] - sums[:n]) * down[:n])
    # least hash of each window with its leftmost place: the place rides in the low bits
    bits = _U(PLACE_BITS)
    least = ((grams >> bits) << bits) | np.arange(n, dtype=_U)
    span, width = length - kgram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(raw) - length + 1], least[span - width : span - width + len(raw) - length + 1])
    place = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    # windows inside one text, cut where the anchor's place changes
    whole = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), whole)
    first = np.arange(len(owner)) + np.repeat(base - np.cumsum(whole) + whole, whole)
    head = np.flatnonzero((np.diff(place[first], prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    windows = np.diff(np.append(head, len(first)))
    start, owner = first[head], owner[head]
    content = mixed((sums[start + windows + length - 1] - sums[start]) * down[start] + windows.astype(_U))
    return owner, start - base[owner], windows, grams[place[start]].view(np.int64), content.view(np.int64)


def _ranges(docs: DataFrame, length: int, kgram: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            rows = [(i, at, raw[at : at + PART + length - 1]) for i, raw in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True) for at in range(0, len(raw) - length + 1, PART)]
            found = []
            for slab in slabs(rows, lambda r: len(r[2])):
                owner, start, windows, anchor, content = anchored_ranges([r[2] for r in slab], length, kgram)
                ids, at = (np.array([r[k] for r in slab], np.int64) for k in (0, 1))
                found.append((ids[owner], at[owner] + start, windows, anchor, content))
            if not found:
                continue
            ids, start, windows, anchor, content = map(np.concatenate, zip(*found, strict=True))
            again = _again(ids, start, windows, anchor, content)
            # what is known to repeat needs no company: it goes anywhere
            anchor[again] = mixed((ids * 31 + start)[again].view(_U)).view(np.int64)
            yield record_batch(doc_id=ids, start=start, windows=windows.astype(np.int32), anchor=anchor, content=content, again=again)

    return docs.select("doc_id", "text").mapInArrow(frugal(find), "doc_id long, start long, windows int, anchor long, content long, again boolean")


def _again(ids: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which ranges equal one at an earlier place among those given."""
    order = np.lexsort((start, ids, windows, content, anchor))
    a, c, w = anchor[order], content[order], windows[order]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])))[: len(order)])
    first = np.repeat(order[head], np.diff(np.append(head, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = (ids[order] != ids[first]) | (start[order] != start[first])
    return out


def _sorted_slabs(strings: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, windows) of runs of windows in ``strings`` (key, doc_id, start, bytes) that repeat an earlier one."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pyarrow.RecordBatch:
        rows.sort(key=lambda r: (r[0], r[1]))  # earlier strings first: places in the slab then order windows
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        data = np.zeros(int(sizes.sum()) + len(rows), np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1
        inside = np.ones(len(data), bool)
        inside[base + sizes] = False
        data[inside] = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.int64) + 1
        owner = np.repeat(np.arange(len(rows)), sizes + 1)
        valid = np.arange(len(data)) + length <= (base + sizes)[owner]
        # windows of two strings of one document may be the same place: order them by the place itself
        docs = np.array([r[0] for r in rows], np.int64)
        starts = np.array([r[1] for r in rows], np.int64)
        at = starts[owner] + np.arange(len(data)) - base[owner]
        rank = np.cumsum(np.diff(docs, prepend=docs[0]) != 0)[owner] * (int(at.max()) + 1) + at
        places = np.sort(repeated_windows(data, valid, rank, length))
        head = np.flatnonzero((np.diff(places, prepend=-2) != 1) | (np.diff(owner[places], prepend=-1) != 0))
        return record_batch(doc_id=docs[owner[places[head]]], start=at[places[head]], windows=np.diff(np.append(head, len(places))).astype(np.int32))

    def sort_slabs(batches):
        held, total, last = [], 0, None
        for batch in batches:
            for key, doc_id, start, data in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "start", "bytes")), strict=True):
                if total > SLAB and key != last:
                    yield solve(held)
                    held, total = [], 0
                held.append((doc_id, start, data))
                total, last = total + len(data), key
        if held:
            yield solve(held)

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(sort_slabs), "doc_id long, start long, windows int")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _windows_met(strings: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, windows) of all windows of ``strings`` but the first of each content. Equal windows meet by their
    bytes in partial sums; the join back splits what one window has too much of."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("i")
    cut = strings.select("doc_id", "start", "bytes", at).select("doc_id", (F.col("start") + F.col("i")).alias("start"), F.substring("bytes", F.col("i") + 1, F.lit(length)).alias("bytes"))
    first = cut.groupBy("bytes").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last")).where("first <> last").select("bytes", "first")
    # no broadcast: windows that repeat look small once compressed
    return cut.join(first.hint("merge"), "bytes").where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", F.lit(1).alias("windows"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """(doc_id, runs): the maximal runs (start, end) of covered bytes, in order, of the documents that have some. A doc_id
    has one text here."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.where(F.octet_length("text") >= length)
    digests = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n"))
    heads = digests.groupBy("digest", "n").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("_most")).where("head < _most")
    heads = stored(heads, "heads")  # the join splits a text that too many documents share
    copies = stored(digests.join(heads, ["digest", "n"]).where("doc_id <> head").select("doc_id", "n").distinct(), "copies")
    once = texts.join(copies, "doc_id", "left_anti")

    by_anchor = Window.partitionBy("anchor", "again")
    found = _ranges(once, length, kgram).repartition("anchor")
    found = found.withColumn("_n", F.rank().over(Window.partitionBy("anchor", "again", "content", "windows").orderBy("doc_id", "start")))
    found = found.withColumn("_kinds", F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).over(by_anchor))
    found = found.withColumn("_n", F.when(F.col("again"), 2).otherwise(F.col("_n")))
    found = stored(found.where("_n > 1 or _kinds > 1").select("doc_id", "start", "windows", "anchor", "_n", "_kinds"), "ranges")

    # the first of each kind, where an anchor has several kinds, goes to the suffix arrays
    wanted = found.where("_n = 1").groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "anchor", (F.col("_kinds") > CROWDED).alias("crowded"))).alias("ranges"))
    bytes_of = lambda raw: F.transform("ranges", lambda r: F.struct(r["anchor"].alias("key"), r["start"].alias("start"), r["crowded"].alias("crowded"), F.substring(raw, (r["start"] + 1).cast("int"), r["windows"] + length - 1).alias("bytes")))
    strings = once.join(wanted, "doc_id").select("doc_id", F.explode(_let(F.col("text").cast("binary"), bytes_of)).alias("s")).select("doc_id", "s.*")
    spans = _sorted_slabs(strings.where("not crowded").drop("crowded"), length).union(found.where("_n > 1").select("doc_id", "start", "windows"))
    if not found.where((F.col("_n") == 1) & (F.col("_kinds") > CROWDED)).isEmpty():
        crowded = stored(strings.where("crowded"), "crowded")
        spans = spans.union(_windows_met(crowded, length))
    # start and end in one number: what is gathered for a document, and sorted by it, is eight bytes a span
    spans = spans.select("doc_id", (F.col("start") * F.lit(1 << 31) + F.col("start") + F.col("windows") + (length - 1)).alias("span"))
    spans = spans.union(copies.select("doc_id", F.col("n").cast("long")))
    runs = stored(spans.groupBy("doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans")).select("doc_id", _runs(F.col("spans")).alias("runs")), "runs")
    for done in (heads, copies, found):
        drop_stored(done)
    return runs


def _runs(spans: Column) -> Column:
    """Sorted spans (start * 2**31 + end) as maximal runs."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    first = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    last = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def step(s: Column, span: Column) -> Column:
        start, end = F.shiftright(span, 31).cast("int"), span.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        longer = F.struct(s["done"].alias("done"), s["start"].alias("start"), F.greatest(s["end"], end).alias("end"))
        fresh = F.struct(F.when(s["end"] < 0, s["done"]).otherwise(F.concat(s["done"], last(s))).alias("done"), start.alias("start"), end.alias("end"))
        return F.when((s["end"] >= 0) & (start <= s["end"]), longer).otherwise(fresh)

    return F.aggregate(spans, first, step, lambda s: F.concat(s["done"], last(s)))


def _kept(raw: Column, runs: Column) -> Column:
    """The bytes of ``raw`` outside ``runs``."""
    begin = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    end = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.octet_length(raw)))
    return F.unhex(F.array_join(F.zip_with(begin, end, lambda a, b: F.hex(F.substring(raw, a + 1, b - a))), ""))


def _whole_characters(raw: Column, runs: Column) -> Column:
    """``runs`` of UTF-8 bytes drawn in to characters that lie in them whole."""
    after = lambda at: F.length(F.regexp_extract(F.hex(F.substring(raw, at + 1, F.lit(3))), "^(?:[89AB].)*", 0))
    before = lambda at: F.length(F.regexp_extract(F.hex(F.substring(raw, at - 2, F.lit(3))), "(?:[89AB].)*$", 0))
    return F.transform(runs, lambda r: F.struct((r["start"] + (after(r["start"]) / 2).cast("int")).alias("start"), F.when(after(r["end"]) > 0, r["end"] - 1 - (before(r["end"]) / 2).cast("int")).otherwise(r["end"]).alias("end")))


def _marked(docs: DataFrame, length: int, kgram: int) -> tuple[DataFrame, str]:
    """``docs`` with one column more, and its name: the runs of its text that go, or null."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    numbered = numbered_texts(docs)
    rows = numbered[0] if numbered else docs
    own = free_name(docs.columns, "_runs")
    found = repeated_runs(rows, length, kgram).withColumnRenamed("runs", own)
    marked = rows.join(found, "doc_id", "left")
    if numbered:  # back to the doc_id it came with
        number, name = (free_name(marked.columns, x) for x in ("_number", "_name"))
        names = numbered[1].select(F.col("number").alias(number), F.col("doc_id").alias(name))
        marked = marked.join(names, F.col("doc_id") == F.col(number)).withColumn("doc_id", F.col(name)).drop(number, name)
    return marked, own


def removal_report(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    marked, _ = _marked(docs.select("doc_id", "text"), length, kgram)
    rows = marked.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.coalesce("_runs", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("runs"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    kept = F.when(F.size("runs") == 0, F.sha2("raw", 256)).otherwise(_let(F.col("raw"), lambda raw: F.sha2(_kept(raw, F.col("runs")), 256)))
    return rows.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), kept.alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of text, to whole characters; all other columns as they were."""
    marked, runs = _marked(docs, length, kgram)
    cut = _let(F.col("text").cast("binary"), lambda raw: _kept(raw, _whole_characters(raw, F.col(runs))).cast("string"))
    return marked.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


#: Every string of 100 bytes, as hexadecimal digits; doc_ids must not repeat.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 - 99 AS BIGINT), 256)) AS low FROM texts WHERE length(h) >= 200
), parts AS (
  SELECT doc_id, low, substring(h, 2 * low + 1, 710) AS h FROM starts
), places AS (
  SELECT doc_id, low, h, unnest(range(least(256, CAST(length(h) / 2 - 99 AS BIGINT)))) AS j FROM parts
), strings AS (
  SELECT doc_id, low + j AS i, row_number() OVER (PARTITION BY md5(substring(h, 2 * j + 1, 200)) ORDER BY doc_id, low + j) AS n FROM places
), again AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM strings WHERE n > 1
), numbered AS (
  SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM again
), runs AS (
  SELECT doc_id, run, min(i) AS low, max(i) + 100 AS high FROM numbered GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS kept_from FROM runs
), kept AS (
  SELECT c.doc_id, sum(high - low) AS removed, count(*) AS spans, string_agg(substring(t.h, 2 * kept_from + 1, 2 * (low - kept_from)), '' ORDER BY low) || substring(any_value(t.h), 2 * max(high) + 1) AS h
  FROM cut c JOIN texts t ON t.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT t.doc_id, CAST(length(t.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
