import random

import numpy as np
import pytest

from vecspark.llm import hashing


@pytest.mark.parametrize("stretch", [1, 2, 7, 64, 1 << 18])
def test_words_have_hashes_of_their_own(monkeypatch, stretch):
    rng = random.Random(stretch)
    monkeypatch.setattr(hashing, "STRETCH", stretch)
    monkeypatch.setattr(hashing, "_powers", [])
    seen = {}
    for _ in range(200):
        texts = [bytes(rng.choices(b"aBbc \t\n\x0b\x0c\r\xc3\xa9\x00", k=rng.randint(0, rng.choice([3, 40])))) for _ in range(rng.randint(0, 6))]
        hashes, counts = hashing.word_hashes(texts)
        assert counts.tolist() == [len(t.split()) for t in texts]
        words = [w.lower() for t in texts for w in t.split()]
        assert len(words) == len(hashes)
        for h, w in zip(hashes.tolist(), words, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_alike_words_differ():
    words = [bytes([a, b, c]) for a in range(97, 123) for b in range(97, 123) for c in range(97, 123)] + [b"a" * n for n in range(4, 2000)]
    hashes, _ = hashing.word_hashes([b" ".join(words)])
    assert len(np.unique(hashes)) == len(words)
