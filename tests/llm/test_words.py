import random

import numpy as np
import pyarrow as pa

from quire.llm.words import gram_hashes, gram_starts, slabs, word_hashes, words
from tests.llm.conftest import ODD, lowered, split

TEXTS = [r[1] for r in ODD] + ["A b\x0bC", "tail ", " head"]


def test_words_and_hashes_of_slabs_equal_python_splits():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abAB \n\té") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for limit in (1, 64, 1 << 20):
        known: dict[int, str] = {}
        seen: dict[str, int] = {}
        at = 0
        for slab in slabs(pa.array(texts), limit):
            assert slab.first == at
            at = slab.last
            low = slab.lowered()
            found = words(low)
            hashes = word_hashes(low, found)
            raw = low.data.tobytes()
            own = [raw[b:e].decode() for b, e in zip(found.begin, found.end, strict=True)]
            for d in range(slab.last - slab.first):
                assert own[found.at[d] : found.at[d + 1]] == split(lowered(texts[slab.first + d]))
            for w, h in zip(own, hashes.tolist(), strict=True):
                assert known.setdefault(h, w) == w and seen.setdefault(w, h) == h
        assert at == len(texts)


def test_grams_agree_exactly_where_words_agree():
    texts = ["a b c a b c a b", "a b", None, "c a b c"]
    (slab,) = slabs(pa.array(texts))
    found = words(slab)
    at = gram_starts(found, 3)
    grams = gram_hashes(word_hashes(slab, found), 3)[at]
    expected = [tuple(w[i : i + 3]) for w in map(split, texts) for i in range(len(w) - 2)]
    assert len(expected) == len(grams)
    assert len({*zip(expected, grams.tolist(), strict=True)}) == len({*expected}) == len({*grams.tolist()})


def test_empty_columns():
    assert list(slabs(pa.array([], pa.string()))) == []
    (slab,) = slabs(pa.array([None, ""], pa.string()))
    assert len(words(slab).begin) == 0 and words(slab).at.tolist() == [0, 0, 0]
    assert gram_hashes(np.zeros(2, np.uint64), 5).size == 0
