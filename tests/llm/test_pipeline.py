import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import packing, source_mix, toxicity

from . import test_near_duplicates
from .fixtures import corpus, frame
from .test_classifiers import labelled


def without_toxic(rows, machine):
    out = []
    for i, t, source in rows:
        own = toxicity.terms([(t or "").encode()])[0]
        v = machine.factors[own].astype(float)
        pairs = (v.sum(0) ** 2 - (v**2).sum(0)).sum() / 2
        if machine.intercept + machine.weights[own].astype(float).sum() + pairs < 0:
            out.append((i, t, source))
    return out


def without_near_duplicates(rows):
    kept = {i for i, _, _, own in test_near_duplicates.plain([r[:2] for r in rows], 5) if own}
    return [r for r in rows if r[0] in kept]


def without_passages(rows, length=100):
    seen, out = {}, []
    for i, t, source in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            kept += [] if all(gone[at : at + n]) else [c]
            at += n
        if not t or kept:
            out.append((i, None if t is None else "".join(kept), source))
    return out


def mixed(rows):
    sizes = Counter()
    for _, t, source in rows:
        sizes[source] += len((t or "").encode()) + 1
    weights, total = {s: n**source_mix.ALPHA for s, n in sizes.items()}, sum(sizes.values())
    out = []
    for i, t, source in rows:
        rate = weights[source] / sum(weights.values()) * total / sizes[source]
        u = (int(hashlib.md5(f"{source_mix.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, log, below = 0, -rate, math.exp(-rate)
        while below < u:
            n += 1
            log += math.log(rate / n)
            below += math.exp(log)
        out += [(i, t)] * n
    return out


def pieces(rows):
    with packing.encoder(packing.vocabulary_path()) as encode:
        ids = encode([t or "" for _, t in rows])
    step = 4 * packing.CAPACITY
    return Counter((i, k, at // 4, len(x[at : at + step]) // 4, zlib.crc32(x[at : at + step])) for (i, _), x in zip(rows, (x + b"\1\0\0\0" for x in ids), strict=True) for k, at in enumerate(range(0, len(x), step)))


def test_run_equals_a_plain_version(spark, tmp_path):
    toxic, labels = labelled(spark, 300)
    rows = corpus(21, 90) + [(1000 + i, t) for i, t in toxic]
    rows += [(5000 + k, t + " end") for k, (_, t) in enumerate(toxic[:40])] + [(6000, "x " + rows[3][1] * 2), (6001, "word " * 6000)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame([(1000 + i, y) for i, y in labels], "doc_id long, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    machine = toxicity.train(docs, marks)
    want = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    counts = [len(want)]
    for stage in (lambda x: without_toxic(x, machine), without_near_duplicates, without_passages):
        want = stage(want)
        counts.append(len(want))
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(mixed(want))
    used = np.zeros(max(r.sequence_id for r in got) + 1, np.int64)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert used.max() <= packing.CAPACITY


def test_odd_ids_pass_through_all_stages(spark, tmp_path):
    big = 2**60 + 1
    rows = [(big, "one two three four five six"), (big, "another text of the same id here"), (big + 1, "seven words that nobody else has written"), (big + 1, "seven words that nobody else has written"), (None, "no id but a text of its own"), (None, None), (7, "")]
    docs = frame(spark, rows).withColumn("rider", F.when(F.col("doc_id") == big, F.lit(big)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(big, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
    got = sorted((str(r.doc_id), r.text or "", str(r.rider)) for r in docs.collect())
    # equal rows stay once
    assert got == sorted((str(i), t or "", str(big if i == big else None)) for i, t in dict.fromkeys(rows))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= {i for i, _ in rows}


def test_stages_in_order(spark, tmp_path):
    rows = corpus(11, 60)
    clashing = {c: F.lit("own") for c in ("copy", "toxicity", "_copy", "_spans", "shuffle_key", "kept", "_had", "_source")}
    frame(spark, rows).withColumns(clashing).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, texts = docs.columns, {i: t for i, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        kept = out.collect()
        assert all(r[c] == "own" for r in kept for c in clashing)
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in kept} <= before
        if name == "toxicity":
            assert len(kept) == len(rows)
        if name == "near_duplicates":
            assert all(r.text == texts[r.doc_id] for r in kept) and {r.doc_id for r in kept if (r.text or "").strip() == ""} == {i for i, t in rows if not (t or "").strip()}
        if name == "repeated_passages":
            assert all(r.n_chars == len(r.text or "") for r in kept)
        docs = spark.createDataFrame(kept, out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] == packing.token_pieces(docs, packing.vocabulary_path()).agg(F.sum("length")).first()[0]
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() <= len(rows)


def test_empty_documents(spark, tmp_path):
    frame(spark, corpus(1, 5)).where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
