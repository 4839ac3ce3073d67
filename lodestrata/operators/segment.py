"""Segmentation: a markdown document becomes parent sections and overlapping search windows.

One row is one document throughout, and every step is an expression on it: no shuffle, no Python. A step is a
projection of its own, so that the optimizer doesn't repeat a fold for each of its uses.

Rows may be as many as there are; a document is as long as a row may be. Null and blank texts have no parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import parent_id
from lodestrata.functions.text import heading, is_fence, lines, odd_lines, strip
from lodestrata.settings import Settings

LABEL_RANGE = " ... "
PARAGRAPH = "\n\n"

_SECTIONS = "array<struct<label:string,text:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


#: White space before a heading, from a newline on, or at the end, in a text whose only line ends are newlines.
_SPACE = r"[\s\x1c-\x1f]"
_BEFORE_HEADING = rf"(?U)\n(?:{_SPACE}*\n)?(?=#{{1,3}}[\s\x1c-\x1f&&[^\n]]+[^\s\x1c-\x1f])|\n{_SPACE}*\z"


def sections(markdown: Column) -> Column:
    """array<struct<label, text>>: the document cut at headings of level one to three outside fences.

    Fences toggle, whatever their kind; one that never closes swallows the rest. A heading stays as the label alone.
    Sections without text vanish, and text before the first heading has no label. Texts without fences and without other
    line ends than newlines, which are most, are split by one regex; others go line by line.
    """
    def plain(piece: Column) -> Column:
        first = F.substring_index(piece, "\n", 1)
        return _let(F.when(piece.startswith("#"), heading(first)).otherwise(""), lambda label: F.struct(F.when(label != "", label).alias("label"), strip(F.when(label != "", F.substr(piece, F.length(first) + 2)).otherwise(piece)).alias("text")))

    by_line = F.when(_may_fence(markdown) | odd_lines(markdown), _let(lines(markdown), _cut_lines)).otherwise(F.transform(F.split(markdown, _BEFORE_HEADING), plain))
    return F.when(markdown.isNull(), _empty(_SECTIONS)).otherwise(F.filter(by_line, lambda x: x["text"] != ""))


def _cut_lines(every: Column) -> Column:
    """The sections of a document's lines."""
    n = F.size(every)

    def split(labels: Column) -> Column:
        # in order: places of headings, and -1 for each fence. Only these few are folded, not all lines
        marks = F.filter(F.transform(every, lambda x, i: F.when(F.get(labels, i) != "", i).when(_may_fence(x) & is_fence(x), -1)), lambda m: m.isNotNull())
        start = F.struct(F.lit(False).alias("inside"), _empty("array<int>").alias("heads"))

        def step(s: Column, m: Column) -> Column:
            kept = F.when((m >= 0) & ~s["inside"], F.concat(s["heads"], F.array(m))).otherwise(s["heads"])
            return F.struct((s["inside"] != (m < 0)).alias("inside"), kept.alias("heads"))

        heads = F.aggregate(marks, start, step, lambda s: s["heads"])
        return _let(heads, lambda h: F.transform(F.concat(F.array(F.lit(-1)), h), lambda at, k: section(labels, at, F.coalesce(F.get(h, k), n))))

    def section(labels: Column, at: Column, end: Column) -> Column:
        label = F.when(at >= 0, F.get(labels, F.greatest(at, F.lit(0))))
        return F.struct(label.alias("label"), strip(F.array_join(F.slice(every, at + 2, end - at - 1), "\n")).alias("text"))

    return _let(F.transform(every, lambda x: F.when(x.startswith("#"), heading(x)).otherwise("")), split)


def _may_fence(text: Column) -> Column:
    return text.contains("```") | text.contains("~~~")


def merged_label(labels: Column) -> Column:
    """First and last label of a group, or the one label; null without any."""
    some = F.filter(labels, lambda x: x.isNotNull() & (x != ""))
    first, last = F.get(some, F.lit(0)), F.get(some, F.size(some) - 1)
    return F.when(F.size(some) == 0, F.lit(None).cast("string")).when(first == last, first).otherwise(F.concat(first, F.lit(LABEL_RANGE), last))


def merged(secs: Column, merge_below: int) -> Column:
    """Sections joined from left to right until a group has ``merge_below`` characters, separators not counted. A short
    rest joins the last group, or stands alone where there is none."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), _empty("array<int>").alias("ends"))

    def step(s: Column, length: Column) -> Column:
        n, at = s["n"] + length, s["at"] + 1
        full = n >= merge_below
        return F.struct(at.alias("at"), F.when(full, 0).otherwise(n).alias("n"), F.when(full, F.concat(s["ends"], F.array(at))).otherwise(s["ends"]).alias("ends"))

    # numbers alone are folded: the ends of groups, of which the last one reaches the end
    ends = F.aggregate(F.transform(secs, lambda x: F.length(x["text"])), start, step, lambda s: F.concat(F.slice(s["ends"], F.lit(1), F.greatest(F.size(s["ends"]) - 1, F.lit(0))), F.array(s["at"])))

    def joined(group: Column) -> Column:
        return F.struct(merged_label(F.transform(group, lambda x: x["label"])).alias("label"), F.array_join(F.transform(group, lambda x: x["text"]), PARAGRAPH).alias("text"))

    def cut(every: Column) -> Column:
        def group(end: Column, k: Column) -> Column:
            begin = F.when(k > 0, F.get(every, k - 1)).otherwise(0)
            return _let(F.slice(secs, begin + 1, end - begin), joined)

        return F.transform(every, group)

    return F.when(F.size(secs) > 0, _let(ends, cut)).otherwise(_empty(_SECTIONS))


def packed(text: Column, split_above: int) -> Column:
    """Pieces of at most ``split_above`` characters: paragraphs packed in order; a paragraph that is too long is cut
    hard, and what is left of it packs with the next."""
    start = F.struct(_empty("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit(PARAGRAPH), p))

        def hard(done: Column) -> Column:
            # whole cuts of p, and what is left: one character at least
            cuts = F.floor((F.length(p) - 1) / split_above).cast("int")
            parts = F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substr(p, i * split_above + 1, F.lit(split_above)))
            return F.struct(F.when(cuts > 0, F.concat(done, parts)).otherwise(done).alias("done"), F.when(cuts > 0, F.substr(p, cuts * split_above + 1)).otherwise(p).alias("open"))

        flushed = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        fits = F.length(joined) <= split_above
        return F.when(fits, F.struct(s["done"].alias("done"), joined.alias("open"))).otherwise(_let(flushed, hard))

    folded = F.aggregate(F.split(text, PARAGRAPH), start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.length(text) <= split_above, F.array(text)).otherwise(folded)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that start ``size - overlap`` apart; the last one reaches the end, and is short if
    need be. No window lies wholly inside the one before. An empty text has none."""
    stride = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / stride), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * stride + 1, F.lit(size)))
    return F.filter(cut, lambda w: w != "")


def parents(docs: DataFrame, settings: Settings = Settings(), *, markdown: str = "markdown", source_file: str = "source_file") -> DataFrame:
    """One row per parent: the other columns of ``docs``, source_file, parent_index, parent_id, section_label, text."""
    s = settings.checked()
    others = [c for c in docs.columns if c not in (markdown, source_file)]
    cut = docs.select(*others, F.col(source_file).alias("source_file"), sections(F.col(markdown)).alias("_s"))
    grouped = cut.select(*others, "source_file", merged(F.col("_s"), s.merge_below).alias("_s"))
    pieces = F.flatten(F.transform("_s", lambda x: F.transform(packed(x["text"], s.split_above), lambda t: F.struct(x["label"].alias("section_label"), t.alias("text")))))
    rows = grouped.select(*others, "source_file", F.posexplode(pieces).alias("parent_index", "_p"))
    return rows.select(*others, "source_file", "parent_index", parent_id(F.col("source_file"), F.col("parent_index")).alias("parent_id"), "_p.section_label", "_p.text")


def children(parent_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per window of each parent, with the parent's other columns and child_index."""
    s = settings.checked()
    others = [c for c in parent_rows.columns if c != "text"]
    return parent_rows.select(*others, F.posexplode(windows(F.col("text"), s.child_size, s.child_overlap)).alias("child_index", "text"))


def chunk(docs: DataFrame, settings: Settings = Settings(), **columns: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of ``docs``, from one lineage."""
    rows = parents(docs, settings, **columns)
    return rows, children(rows, settings)
