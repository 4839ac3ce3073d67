"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text (runs of ASCII letters and digits and of all non-ASCII bytes) and
their first four, five and seven bytes, hashed to 2**18 features. The score is
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)``: besides a weight for each term, the machine learns pairwise
interactions, so that two terms can mean more, or less, together than apart (an insult next to a group's name).

Terms that take part: those in ``min_rows`` training rows or more whose label counts are ``least_surprise`` standard
errors or more from chance, and those of surprising pairs, however neutral each is alone. A pair is surprising if what the
first terms' weights alone leave unexplained, summed over the rows that hold both terms, is ``pair_surprise`` standard errors
or more from chance. All pairs are tested, but for terms for which no choice whatsoever among their rows gives such a sum:
these can't be in such a pair. All terms that take part have weights and factors; the others would only add noise.

Training: at most ``max_rows`` labelled rows, those with the least seeded hash of doc_id (so the sample is uniform,
repeatable and bounded whatever the size), reduced to hashed terms on the executors; of rows with equal terms one is
used, or a copied document would teach its own words, and of rows that repeat a doc_id the one whose terms come first.
Only hashed terms and labels come to the driver, of whole rows, in the order of the seeded hashes while they make no more
than ``max_bytes``, so what it holds is bounded in rows and bytes. The driver fits by AdaGrad. Rows of each class weigh so
classes balance; the intercept is then set so that 0.5 is the cut with the best F1 of the sample's rows as scored by
machines fitted without them (``FOLDS`` parts).

Scoring: one pass over whole texts, no shuffle. Null and empty texts have no terms and get the score of the intercept
alone. Rows that repeat a doc_id are scored each, and so are rows without one. Without labelled rows of both classes all
scores are 0. An empty table gives no rows. Columns lang, source and doc_id are never inputs; other columns ride along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_TERM, as_bytes, free_name, frugal, record_batch, slabs, table, tune, utf8, word_hashes

FEATURES, FACTORS = 1 << 18, 4
#: Besides whole words, their first so many bytes are terms: insults are inflected and compounded.
HEADS = (4, 5, 7)
MAX_ROWS, MIN_ROWS, SEED = 12_000, 4, 7
#: Bytes of the training rows' terms, steps of fitting, and parts that find the cut.
MAX_BYTES, STEPS, FOLDS = 64 << 20, 720, 4

_U = np.uint64


def terms(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashed terms of each text (UTF-8), sorted."""
    out = []
    for slab in slabs(texts, len):
        words, counts = word_hashes(slab, NOT_TERM, HEADS)
        ids = (words >> _U(64 - 18)).astype(np.int32)
        at = 0
        for n in counts.tolist():
            own = np.sort(ids[at : at + n], axis=None)
            out.append(own[np.diff(own, prepend=-1) != 0])
            at += n
    return out


@dataclass
class Machine:
    """An intercept, a weight for each feature, and a row of factors for each feature."""

    intercept: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the sigmoid."""
        out = np.full(len(rows), self.intercept)
        sizes = np.array([len(r) for r in rows])
        some = np.flatnonzero(sizes)
        if len(some):
            ids = np.concatenate([rows[i] for i in some])
            head = np.cumsum(sizes[some]) - sizes[some]
            v = self.factors[ids]
            total = np.add.reduceat(v, head)
            out[some] += np.add.reduceat(self.weights[ids], head) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), head))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, features: int = FEATURES, factors: int = FACTORS, min_rows: int = MIN_ROWS, least_surprise: float = 5.5, pair_surprise: float = 8.0, steps: int = STEPS, seed: int = SEED) -> Machine:
    """AdaGrad on the logistic loss, rows of both classes weighing the same in sum."""
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        return Machine(-40.0, np.zeros(features), np.zeros((features, factors)))
    common, toxic = np.zeros(features), np.zeros(features)
    for r, y in zip(rows, labels, strict=True):
        common[r] += 1
        toxic[r] += y
    base = labels.mean()
    surprise = np.abs(toxic - base * common) / np.sqrt(np.maximum(base * (1 - base) * common, 1e-9))
    keep = (common >= min_rows) & (surprise >= least_surprise)
    every, fold = np.arange(len(rows)), rng.integers(0, FOLDS, len(rows))
    linear = _fitted([r[keep[r]] for r in rows], labels, every, Machine(0.0, np.zeros(features), np.zeros((features, 1))), rng, steps)
    linear.intercept -= np.log((1 - base) / base)  # classes were balanced
    rest = labels - linear.scores([r[keep[r]] for r in rows])
    keep[_paired(rows, rest, _pairable(rows, rest, features, pair_surprise), features, pair_surprise)] = True
    rows = [r[keep[r]] for r in rows]
    first = np.where(keep[:, None], rng.normal(0, 0.05, (features, factors)), 0.0)
    grown = lambda which: _fitted(rows, labels, which, Machine(0.0, np.zeros(features), first.copy()), rng, steps)
    # each fold is scored by a machine that hasn't seen it; 0.5 is put where these scores are cut best
    raw = np.zeros(len(rows))
    for k in range(FOLDS):
        own, others = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(own) and len(others) and labels[others].min() < labels[others].max():
            raw[own] = grown(others).raw([rows[i] for i in own])
    machine = grown(every)
    machine.intercept -= best_cut(raw, labels)
    machine.weights, machine.factors = machine.weights.astype(np.float32), machine.factors.astype(np.float32)
    return machine


def _pairable(rows: list[np.ndarray], rest: np.ndarray, features: int, least: float) -> np.ndarray:
    """The terms that have rows whose sum of ``rest`` is surprising, were a pair in just these. Of all choices among rows of
    one sign, the best are the first so many in the order of size: a row is worth choosing if it is under some bound."""
    found, ids, rest = np.zeros(features, bool), np.concatenate([*rows, np.zeros(0, np.int32)]), np.repeat(rest, [len(r) for r in rows])
    step = max(1, features >> 4)
    for at in range(0, features, step):  # by blocks of terms, which bounds the memory
        own = (ids >= at) & (ids < at + step)
        for sign in (1.0, -1.0):
            some = own & (sign * rest > 0)
            i, x = ids[some], sign * rest[some]
            order = np.lexsort((x, i))
            i, x = i[order], x[order]
            head = np.flatnonzero(np.diff(i, prepend=-1))
            size = np.diff(np.append(head, len(i)))
            sums, squares = (np.cumsum(c) - np.repeat(np.cumsum(c)[head] - c[head], size) for c in (x, x**2))
            found[i[sums >= least * np.sqrt(squares + 0.25) * (1 - 1e-9)]] = True
    return np.flatnonzero(found)


def _paired(rows: list[np.ndarray], rest: np.ndarray, some: np.ndarray, features: int, least: float) -> np.ndarray:
    """The terms among ``some`` that form a pair with a surprising sum of ``rest`` over the rows that hold both."""
    place = np.full(features, -1)
    place[some] = np.arange(len(some))
    own = [p[p >= 0] for p in (place[r] for r in rows)]
    sums, squares = (np.zeros((len(some), len(some)), np.float32) for _ in range(2))
    for at in range(0, len(rows), 1024):
        part = own[at : at + 1024]
        x = np.zeros((len(part), len(some)), np.float32)
        x[np.repeat(np.arange(len(part)), [len(p) for p in part]), np.concatenate(part)] = 1
        r = rest[at : at + 1024].astype(np.float32)[:, None]
        sums += x.T @ (x * r)
        squares += x.T @ (x * r**2)
    odd = np.abs(sums) >= least * np.sqrt(squares + 0.25)
    np.fill_diagonal(odd, False)
    return some[odd.any(1)]


def _fitted(rows: list[np.ndarray], labels: np.ndarray, fitted: np.ndarray, machine: Machine, rng: np.random.Generator, steps: int, rate: float = 0.2, decay: float = 2e-3) -> Machine:
    features, factors = machine.factors.shape
    share = labels[fitted].mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    gw, gv, g0 = np.full(features, 1e-6), np.full((features, factors), 1e-6), 1e-6
    per_epoch = max(1, len(fitted) // 128)
    for _ in range(-(-steps // per_epoch)):
        for batch in np.array_split(rng.permutation(fitted), per_epoch):
            own = [rows[i] for i in batch]
            error = (machine.scores(own) - labels[batch]) * weight[batch] / len(batch)
            g0 += error.sum() ** 2
            machine.intercept -= rate * error.sum() / np.sqrt(g0)
            sizes = np.array([len(r) for r in own])
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            ids, back = np.unique(np.concatenate([own[i] for i in some]), return_inverse=True)
            head = np.cumsum(sizes[some]) - sizes[some]
            per = np.repeat(error[some], sizes[some])
            dw = np.bincount(back, per, len(ids)) + decay * machine.weights[ids] / len(batch)
            gw[ids] += dw**2
            v = machine.factors[ids]
            if v.any():
                total = np.repeat(np.add.reduceat(v[back], head), sizes[some], axis=0)
                slope = per[:, None] * (total - v[back])
                dv = np.stack([np.bincount(back, slope[:, k], len(ids)) for k in range(factors)], 1) + decay * v / len(batch)
                gv[ids] += dv**2
                machine.factors[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
            machine.weights[ids] -= rate * dw / np.sqrt(gw[ids])
    return machine


def best_cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """The raw score whose cut has the best F1, halfway to the next lower score; the lowest of several."""
    order = np.argsort(-raw, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(raw) + 1) + labels.sum())
    k = int(np.flatnonzero(f1 == f1.max())[-1])
    return float((raw[order[k]] + raw[order[min(k + 1, len(raw) - 1)]]) / 2)


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _hashed(texts: DataFrame) -> DataFrame:
    """doc_id, text, label -> doc_id, label, terms (little-endian int32 bytes)."""

    def reduce(batches):
        for batch in batches:
            yield record_batch(doc_id=batch["doc_id"], label=batch["label"], terms=pyarrow.array([t.astype("<i4").tobytes() for t in terms(utf8(batch["text"]))], pyarrow.binary()))

    return texts.select("doc_id", "label", "text").mapInArrow(frugal(reduce), "doc_id long, label int, terms binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Machine:
    """A machine from labelled rows whose crc32(doc_id) modulo 5 isn't 0, ``max_rows`` and ``max_bytes`` of terms at most. A
    doc_id with several labels counts as toxic if one of them says so."""
    tune(docs.sparkSession)
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    seeded = F.xxhash64(F.lit(SEED), "doc_id")
    wanted = wanted.orderBy(seeded, "doc_id").limit(max_rows)
    # max_rows ids at most: small whatever the tables hold
    found = _hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id"))
    # one row for each id, then one for each set of terms: partial sums before anything is sent
    found = found.groupBy("doc_id", "label").agg(F.min("terms").alias("terms")).groupBy("terms").agg(F.min(F.struct("doc_id", "label")).alias("m")).select("m.doc_id", "m.label", "terms")
    rows, held = [], 0
    for r in found.orderBy(seeded, "doc_id").toLocalIterator():
        held += len(r.terms)
        if held > max_bytes:
            break
        rows.append((r.doc_id, r.label, np.frombuffer(bytes(r.terms), "<i4")))
    rows.sort(key=lambda r: r[0])
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], np.float64))


def scored(docs: DataFrame, machine: Machine, name: str = "toxicity") -> DataFrame:
    """``docs`` with the score as ``name``, a double from 0 to 1; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by the number of features
    tune(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from frugal(lambda texts: (pd.Series(held.value.scores(terms([as_bytes(x) for x in t]))) for t in texts))(batches)

    return docs.withColumn(name, score("text"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the machine doesn't take as toxic, with the columns they came with."""
    name = free_name(docs.columns, "toxicity")
    return scored(docs, train(docs, labels), name).where(F.col(name) < 0.5).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", _held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
