import hashlib
import random

import pytest

from quire.llm import substring
from tests.llm.conftest import SCHEMA, make_text, split


def brute_force(rows, window):
    """(doc_id, text) -> (words, removed, digest, kept words); rows without id come first."""
    seen, out = set(), {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            gram = tuple(w[i : i + window])
            if gram in seen:
                gone[i : i + window] = [True] * window
            seen.add(gram)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc_id, text] = len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept
    return out


def check(docs, rows, **options):
    expected = brute_force(rows, options.get("window", 20))
    got = substring.remove_repeats(docs, **options).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:4]) for r in got) == sorted(
        (str(r[0]), *expected[r[0], r[1] or ""][:3]) for r in rows
    )
    by_id = {k[0]: v for k, v in expected.items()}
    for r in got:
        if r.n_removed:
            assert split(r.kept_text) == by_id[r.doc_id][3]
            assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed
        else:
            assert r.kept_text is None
    return got


def test_repeats_equal_brute_force(table, corpus):
    got = check(table(corpus, extra=True), corpus)
    assert sum(r.n_removed > 0 for r in got) > 20


@pytest.mark.parametrize("seed", range(3))
def test_many_overlapping_repeats(table, seed):
    rng = random.Random(seed)
    rows = [(d, make_text(rng, rng.randint(0, 120), 3 + seed), "", "", 0) for d in range(40)]
    check(table(rows), rows, window=7, block=4)


def test_chunks_smaller_than_the_corpus(table, corpus, monkeypatch):
    """Cross-chunk repeats are found through the buckets."""
    monkeypatch.setattr(substring, "CHUNK", 2000)
    check(table(corpus, files=5), corpus)


def test_stage_keeps_rows_columns_and_untouched_texts(table, corpus):
    docs = table(corpus, extra=True)
    left = substring.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(corpus)
    expected = brute_force(corpus, 20)
    for r in left.collect():
        kept = [v for k, v in expected.items() if k[0] == r.doc_id]
        assert any(split(r.text) == v[3] for v in kept)
    untouched = [r for r in corpus if expected[r[0], r[1] or ""][1] == 0]
    texts = {(r.doc_id, r.text) for r in left.collect()}
    assert all((r[0], r[1]) in texts for r in untouched)


def test_empty_table_and_bad_sizes(table):
    assert substring.remove_repeats(table([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(table([], SCHEMA), window=18, block=10)
