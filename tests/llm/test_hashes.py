import random

import numpy as np

from lodestrata.llm.common import NOT_TERM, word_hashes


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abAB \n\t\x0c,.") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [b"", "é ß É".encode()]
    seen = {}
    hashes, counts = word_hashes(texts)
    want = [w.lower() for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    for w, h in zip(want, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_heads_and_terms():
    hashes, counts = word_hashes([b"loweick, lowei low! lowei-x"], NOT_TERM, (4, 5))
    assert counts.tolist() == [5] and hashes.shape == (5, 3)
    assert hashes[0, 1] == hashes[1, 1] != hashes[1, 0]
    assert hashes[1, 2] == hashes[1, 0] and hashes[2, 1] == hashes[2, 0] and hashes[3, 0] == hashes[1, 0]
    assert word_hashes([])[0].dtype == np.uint64
