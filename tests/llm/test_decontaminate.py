import random

import numpy as np
import pytest

from quire.llm import decontaminate as d
from quire.llm.latent import directions
from tests.llm.conftest import ODD, SCHEMA, make_text

ITEMS = "item_id long, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_bit_parallel_subsequence_equals_dynamic_programming():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 6, rng.integers(1, 70)).astype(np.uint64)
        b = rng.integers(0, 6, rng.integers(0, 150)).astype(np.uint64)
        assert d.common_length(a, b) == lcs(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def leaks(table):
    rng = random.Random(11)
    items = [(k, make_text(rng, rng.randint(15, 60), 5000) + ".") for k in range(30)]
    rows, expected = [], set()
    for k in range(400):
        words = make_text(rng, rng.randint(0, 250), 5000).split()
        if k % 5 == 0:
            i = rng.randrange(len(items))
            own = items[i][1].split()
            if k % 10 == 0:  # a paraphrase: every fifth word is another
                own = [w if (j + k) % 5 else f"other{k}" for j, w in enumerate(own)]
            at = rng.randint(0, len(words))
            words[at:at] = own
            expected.add((k, i))
        rows.append((k, " ".join(words).upper() if k % 2 else " ".join(words), "en", "src0", 0))
    items += [(900, None), (901, ""), (902, "..."), (None, "an item without an id whose words stand nowhere else")]
    return table(rows + ODD, extra=True), table(items, ITEMS), expected


def test_copies_and_paraphrases_are_found_and_others_left(leaks):
    docs, items, expected = leaks
    got = d.contaminated(docs, items).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & expected) >= 0.95 * len(expected) and not found - expected
    assert all((k, i) in found for k, i in expected if k % 10)
    assert all(r.cosine >= d.COSINE and r.common_words <= r.item_words for r in got)


def test_blocks_of_items_give_the_same(leaks, monkeypatch):
    docs, items, _ = leaks
    whole = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
    monkeypatch.setattr(d, "ITEMS", 12)
    parts = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
    assert len(whole ^ parts) <= 0.02 * len(whole)


def test_latent_cosines_recall_exact_ones(spark):
    rng = np.random.default_rng(1)
    topics = rng.random((20, 300)) * (rng.random((20, 300)) < 0.1)
    x = np.abs(rng.random((400, 20)) ** 6 @ topics + 0.01 * rng.random((400, 300)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame(
        [(list(range(300)), [float(v) for v in r]) for r in x], "columns array<long>, values array<double>"
    ).repartition(4)
    keys, v = directions(rows, 24)
    assert keys.tolist() == list(range(300)) and np.allclose(v.T @ v, np.eye(24), atol=1e-5)
    exact, latent = x @ x.T, (x @ v) @ (x @ v).T
    near = exact > np.quantile(exact, 0.99)
    assert (latent[near] > np.quantile(latent, 0.985)).mean() >= 0.9
    _, s, _ = np.linalg.svd(x)
    assert np.linalg.norm(x @ v) ** 2 >= 0.999 * (s[:24] ** 2).sum()


def test_stage_and_empty_tables(table, leaks):
    docs, items, expected = leaks
    left = d.without_contaminated(docs, items)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert ids.count(None) == 1 and not {k for k, _ in expected if k % 10} & set(ids)
    assert d.contaminated(table([], SCHEMA), items).count() == 0
    assert d.contaminated(docs, table([], ITEMS)).count() == 0
    assert d.without_contaminated(docs, table([], ITEMS)).count() == docs.count()


@pytest.mark.parametrize("n", [200, 1000, 4096])
def test_copies_in_long_documents_are_found_among_many_items(table, n):
    """All that the check on words takes, also diluted by rarer words and with a fifth of the words changed."""
    rng = random.Random(n)
    items = [(k, make_text(rng, rng.randint(15, 60), 20000)) for k in range(n)]
    rows, planted = [], set()
    for k in range(80):
        words = [f"rare{k}x{j}" for j in range(400)]
        i = rng.randrange(n)
        own = items[i][1].split()
        if k % 2:
            own = [w if j % 5 else f"other{k}" for j, w in enumerate(own)]
        at = rng.randint(0, 400)
        words[at:at] = own
        planted.add((k, i))
        rows.append((k, " ".join(words), "", "", 0))
    docs = table(rows)
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, table(items, ITEMS)).collect()}
    assert got == planted


def test_items_in_many_documents_and_items_of_common_words_are_found(table):
    rng = random.Random(4)
    stop = [f"s{k}" for k in range(40)]
    hot = " ".join(f"hot{k}" if k % 3 else rng.choice(stop) for k in range(40))
    common = " ".join(rng.choice(stop) for _ in range(20))
    items = [(1, hot), (2, common), (3, make_text(rng, 40, 5000))]
    rows, planted = [], set()
    for k in range(200):
        words = [rng.choice(stop) if rng.random() < 0.5 else f"r{rng.randrange(10**6)}" for _ in range(200)]
        if k % 10 < 3:  # copies and paraphrases in 30 % of the documents
            own = hot.split() if k % 10 else [w if j % 5 else f"other{k}" for j, w in enumerate(hot.split())]
            at = rng.randint(0, len(words))
            words[at:at] = own
            planted.add((k, 1))
        if k % 20 == 7:
            words[50:50] = common.split()
            planted.add((k, 2))
        rows.append((k, " ".join(words), "", "", 0))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(table(rows), table(items, ITEMS)).collect()}
    assert got == planted
