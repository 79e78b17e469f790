import collections
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quire.llm import graph, neardup
from tests.llm.conftest import SCHEMA, lowered, make_text, split


def brute_force(rows, percent=85, size=5):
    """doc_id -> (shingles, component); rows of one doc_id are one node."""
    sets = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        w = split(lowered(text))
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets[doc_id].append(s)
    parent = {d: d for d in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            for x in sets[a]:
                for y in sets[b]:
                    common = len(x & y)
                    if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                        p, q = find(a), find(b)
                        parent[max(p, q)] = min(p, q)
    return {d: (sorted(len(s) for s in sets[d]), None if d is None else find(d)) for d in sets}


@pytest.mark.parametrize("block", [8, 512])
def test_components_equal_brute_force(table, corpus, block):
    rows = sorted(neardup.near_duplicates(table(corpus, extra=True), block=block).collect(), key=str)
    expected = brute_force(corpus)
    assert len(rows) == len(corpus)
    for r in rows:
        sizes, component = expected[r.doc_id]
        assert r.n_shingles in sizes and r.component_id == component
        assert r.kept == (r.doc_id is None or r.doc_id == component)
    assert sum(not r.kept for r in rows) > 20


def test_lists_that_a_hub_does_not_tie_are_compared_in_blocks(table):
    """The first class links with none of the others, which link among themselves."""
    base = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(w if k % 13 else f"z{k}" for k, w in enumerate(base)), "", "", 0)]
    for d in range(1, 40):
        rows.append((d, " ".join(w if k != 7 * d else f"y{d}" for k, w in enumerate(base)), "", "", 0))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(rows), block=16).collect()}
    assert got == {d: c for d, (_, c) in brute_force(rows).items()}
    assert got[0] == 0 and set(got.values()) == {0, 1}


def test_copies_of_a_long_list_are_not_dealt_to_each_other(spark, monkeypatch):
    """A list of 64 nodes of one component and 3 others: the copies meet the others only, and all such pairs meet."""
    nodes = list(range(67))
    lists = spark.createDataFrame([(5, 67, n, 1, 0 if n < 64 else n) for n in nodes], "token long, df long, node long, mask long, component long")
    described = spark.createDataFrame([(n, [1], b"") for n in nodes], "node long, signature array<int>, sketch binary")

    def everyone(*_):
        def run(batches):
            for batch in batches:
                names = batch.schema.names
                low, high, node = (batch.column(names.index(c)) for c in ("low", "high", "node"))
                group = [100 * a + b for a, b in zip(low.to_pylist(), high.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), node], names=["a", "b"])

        return run

    monkeypatch.setattr(neardup, "_collide", everyone)
    rows = neardup.collisions(lists, described, 1, 1, 80, 8).collect()
    assert len(rows) <= 64 + 3 * 10
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r.b].add(r.a)
    assert all(groups[a] & groups[b] for a in nodes for b in range(64, 67))


def test_empty_table_and_repeated_rows(table):
    assert neardup.near_duplicates(table([], SCHEMA)).count() == 0
    rows = [(1, "one two three four five six", "", "", 0)] * 3 + [(2, "one two three four five six", "", "", 0)]
    docs = table(rows, extra=True)
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs).collect()) == [(1, 2, 1, True)] * 3 + [(2, 2, 1, False)]
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [1]


def test_stage_keeps_rows_without_id(table, corpus):
    left = neardup.without_near_duplicates(table(corpus))
    ids = [r.doc_id for r in left.collect()]
    expected = brute_force(corpus)
    assert sorted(i for i in ids if i is not None) == sorted(d for d, (_, c) in expected.items() if d is not None and d == c)
    assert ids.count(None) == 1


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(200, 100), (100, 150), (150, 200), (7, 7), (None, 3), (300, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 150: 100, 200: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_pipeline_drops_near_copies_from_similarity_80_percent(spark, table):
    base = [f"w{k}" for k in range(304)]  # 300 shingles
    near = [w if k not in (40, 80, 120, 160, 200, 240) else f"n{k}" for k, w in enumerate(base)]  # 270 / 330
    rows = [(1, " ".join(base), "en", "src0", 0), (2, " ".join(near), "en", "src0", 0)]
    assert {c for _, c in brute_force(rows, 80).values()} == {1} and len({c for _, c in brute_force(rows).values()}) == 2
    left = corpus_pipeline.drop_near_duplicates(spark, table(rows), "")
    assert [r.doc_id for r in left.collect()] == [1]
    assert neardup.matches_for(85) >= neardup.MATCHES and neardup.matches_for(80) < neardup.MATCHES


def test_truncated_copies_over_the_sketch_size_pass_the_estimate():
    rng = np.random.default_rng(3)
    signature = np.zeros((2, neardup.COORDINATES), np.int32)
    for _ in range(400):
        whole = rng.choice(1 << 32, 20000, replace=False).astype(np.uint32)
        sketches = [np.sort(x)[: neardup.SKETCH] for x in (whole, whole[:17000])]  # similarity 0.85
        block = {
            "node": np.array([1, 2]), "component": np.array([1, 2]), "block": np.array([0, 0]), "mask": np.array([1, 1]),
            "token": -(1 << 31), "low": 0, "high": 0, "signature": signature, "sketch": sketches,
        }
        assert neardup._pairs_of_block(block, neardup.COORDINATES, neardup.MATCHES, 85) == [(1, 2)]


def test_a_block_of_several_sets_over_the_sketch_size():
    rng = np.random.default_rng(5)
    whole = rng.choice(1 << 32, 5000, replace=False).astype(np.uint32)
    other = rng.choice(1 << 32, 5000, replace=False).astype(np.uint32)
    sets = [whole, whole[:4900], other, whole[:4800], other[:4700], other[100:], whole[:2000]]
    n = len(sets)
    block = {
        "node": np.arange(1, n + 1), "component": np.arange(1, n + 1), "block": np.zeros(n, np.int64), "mask": np.ones(n, np.int64),
        "token": -(1 << 31), "low": 0, "high": 0, "signature": np.zeros((n, neardup.COORDINATES), np.int32),
        "sketch": [np.sort(x)[: neardup.SKETCH] for x in sets],
    }
    found = set(neardup._pairs_of_block(block, neardup.COORDINATES, neardup.MATCHES, 85))
    assert {(1, 2), (1, 4), (2, 4), (3, 5), (3, 6), (5, 6)} == found


def test_long_documents_equal_brute_force(table):
    rng = random.Random(9)
    rows = []
    for k in range(4):  # chains of long texts whose ends are not similar, so that lists stay open after the first pass
        base = make_text(rng, 4000, 10**6).split()
        for j in range(7):
            rows.append((10 * k + j, " ".join(base[j * 130 : j * 130 + 2600]), "en", "src0", 0))
    got = {r.doc_id: ([r.n_shingles], r.component_id) for r in neardup.near_duplicates(table(rows)).collect()}
    assert got == brute_force(rows)
    assert all(n >= neardup.SKETCH for (n,), _ in got.values()) and {c for _, c in got.values()} == {0, 10, 20, 30}
