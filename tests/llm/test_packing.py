import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import packing as p

from .fixtures import corpus, frame


def test_word_by_word_encoding_is_that_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(p.vocabulary_path())
    rng = random.Random(4)
    odd = ["don't", "WE'LL.", "ǅ", "Σίσυφος", "ΟΔΟΣ.", "é", "́x", "İ", "a b", "x y", "½", "3.14.", "...", "!?", "​", "<|endoftext|>", "<|ENDOFTEXT|>.", "\x1c", "\x85", "ﬁ", "日本語。", "١٢٣", "a.b,c!", "'s", "x's.", "\U0001f600!", "ÀÉ.", "ẞß", "ÿŸ", "µ²", "\xad.", "a_.", "_", "-,", ",-"]
    texts = [t or "" for _, t in corpus(2, 40)] + ["".join(rng.choice(odd) + rng.choice(["", " ", "  ", "\n"]) for _ in range(12)) for _ in range(300)]
    for cached in (300_000, 20):
        monkeypatch.setattr(p, "CACHED_WORDS", cached)
        with p.encoder(p.vocabulary_path()) as encode:
            found = encode(texts)
        for t, ids in zip(texts, found, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_and_fit(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 40), 100]) for _ in range(rng.choice([0, 1, 50, 3000])))
    runs = p.plan_runs(counts, 100)
    used = Counter()
    for m, lengths in runs:
        assert m > 0 and sum(lengths) <= 100
        for x in lengths:
            used[x] += m
    assert used == counts
    if sum(counts.values()) > 1000:
        least = -(-sum(k * v for k, v in counts.items()) // 100)
        assert sum(m for m, _ in runs) <= max(least * 1.02, counts[100] + 1)


def test_exact_complements_come_first():
    assert sorted(p.plan_runs({70: 1, 30: 1, 60: 1, 25: 1, 15: 1}, 100)) == [(1, (60, 25, 15)), (1, (70, 30))]


@pytest.mark.parametrize("least", [1024, 2])
def test_packed_documents_rebuild(spark, monkeypatch, least):
    monkeypatch.setattr(p, "LEAST_ROWS", least)
    monkeypatch.setattr(p, "ROWS", least)
    rows = corpus(6, 40) + [(7, "again"), (7, "again"), (2**60 + 1, "large"), (None, "no id"), (None, None)]
    docs = frame(spark, rows)
    packed = p.pack_documents(docs, capacity=64)
    found = packed.toPandas().sort_values(["sequence_id", "offset"])
    ends = found.groupby("sequence_id")["length"].cumsum()
    assert (ends - found["length"] == found["offset"]).all() and ends.max() <= 64
    want = Counter()
    with p.encoder(p.vocabulary_path()) as encode:
        whole = encode([t or "" for _, t in rows])
    for (i, _), ids in zip(rows, whole, strict=True):
        ids += b"\1\0\0\0"
        for k, at in enumerate(range(0, len(ids), 256)):
            want[(i, k, at // 4, len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()) == want
    glued = p.sequences(docs, packed, capacity=64).agg(F.sum(F.size("ids"))).first()[0]
    assert glued == found["length"].sum()


def test_empty_table(spark):
    assert p.pack_documents(frame(spark, corpus()).where("doc_id < 0")).count() == 0
