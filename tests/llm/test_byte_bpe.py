import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import byte_bpe as b
from tests.llm.fixtures import corpus, frame

VOCAB = b.vocabulary(b.RANKS)
SHA = lambda x: hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def plain():
    lines = map(bytes.split, open(b.RANKS, "rb"))
    ranks = {base64.b64decode(t): int(r) for t, r in lines}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(texts, plain):
    for text, got in zip(texts, b.encoded([t.encode() for t in texts], VOCAB), strict=True):
        assert got.tolist() == plain.encode_ordinary(text), text[:100]
        assert VOCAB.decoded(got).tobytes() == text.encode()


def test_awkward_texts(plain):
    marks = ["", " ", "  ", "\n", " \n a", "a  b", "a \n b", "a\n\nb  ", "it's we're I'll they'd 'subject ''s \"'s", "'s", "x'", "'", " 's", "\t's", "don't'll", "1'st", "a b 　c", "\x1c\x1d x\x1e", "١٢٣ ²Ⅷ a1b2", "é", "\U0001f600\U0001f600 é", "\0\0a\0", "'rex 'vel 'lll 'r 'v 'l", "<|endoftext|>"]
    check(marks + [t or "" for _, t in corpus()], plain)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'strevmld aA1²é ., \U0001f600")), max_size=40))
def test_any_mix_of_classes(plain, text):
    check([text, text[::-1]], plain)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(plain, text):
    check([text], plain)


def test_long_pre_tokens(plain):
    rng = np.random.default_rng(1)
    texts = ["a" * 5000, "ab" * 3000, "=" * 4097, "".join(rng.choice(list("abcdeéß"), 6000)), "".join(rng.choice(list("!?-=_~"), 3000)), " " * 3000 + "x", "\n" * 3000 + "x"]
    check(texts, plain)
    assert len(VOCAB.ids(b"xyzzyq" * 50_000)) > 200_000  # a third of a million bytes in one piece end in seconds
    assert not any(VOCAB.low) and not VOCAB.buckets


def test_long_texts_are_cut_where_a_pre_token_starts(plain):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("ab'sre.é  \n  1")) for _ in range(60_000))
    parts = list(b.cut(text.encode(), 1000))
    assert b"".join(parts) == text.encode() and len(parts) > 20
    got = np.concatenate(list(b.encoded(parts, VOCAB)))
    assert got.tolist() == plain.encode_ordinary(text)


def test_equal_hashes_are_told_apart(plain, monkeypatch):
    monkeypatch.setattr(b, "powers", lambda n: (np.ones(n, np.uint64), np.ones(n, np.uint64)))  # anagrams collide
    check(["stop pots tops spot", "ab ba"], plain)


def test_rows_stay_and_clashing_columns_do_no_harm(spark, plain):
    rows = [*corpus(), (3, "again"), (None, "no id"), (3, "again")]
    got = sorted(map(tuple, b.encode_decode(frame(spark, rows).repartition(3)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), SHA(np.array(ids, "<u4").tobytes()), SHA((t or "").encode())))
    assert got == sorted(want, key=str)
    assert b.encode_decode(frame(spark, rows).limit(0)).count() == 0


def test_a_column_of_ids(spark, plain):
    rows = [(1, "some words, it's fine"), (2, None), (3, "")]
    got = {r.doc_id: r.ids for r in b.with_ids(frame(spark, rows)).select("doc_id", "ids").collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in rows}


def test_the_query_over_whole_tables(spark, plain):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in b.query(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(docs) == len(got)
    for r in docs:
        ids = plain.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), SHA(np.array(ids, "<u4").tobytes()), SHA((r.text or "").encode()))
