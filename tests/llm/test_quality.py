import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import quality
from quire.llm.words import slabs
from tests.llm.conftest import ODD, SCHEMA, make_text

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(table):
    rng = random.Random(4)
    rows, labels = [], []
    for d in range(240):
        text = make_text(rng, rng.randint(20, 200), 900).capitalize() + ".\n" + make_text(rng, 20, 900).capitalize() + "."
        if d % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif d % 4 == 1 and d % 8 == 1:
            text = " | ".join(text.split())
        rows.append((d, text, "en", "src0", 0))
        labels.append((d, int(d % 4 != 0 and d % 8 != 1), 0))
    labels += [(None, 1, 1), (5, None, 1), (99999, 0, 1), (6, 0, 1)]
    return table(rows + ODD, extra=True), table(labels, LABELS), labels


def test_held_out_accuracy_and_columns(labelled):
    docs, labels, known = labelled
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == 240 + len(ODD)
    truth = {d: q for d, q, _ in known[:240]}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95 and len(held) > 30
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    empty = {r.score for r in rows if r.doc_id in (90001, 90002)}
    assert len(empty) == 1 and 0.4 < empty.pop() < 0.8


def test_votes_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [make_text(random.Random(k), 30 + k, 50).title() + "!" * (k % 3) for k in range(40)]
    (slab,) = slabs(pa.array(texts))
    idf = np.ones(quality.FEATURES, np.float32)
    x = quality.vectors(slab, idf)
    base = np.linalg.qr(rng.normal(size=(quality.FEATURES, 8)))[0].astype(np.float32)
    known = x[:20] @ base
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    label = (np.arange(20) % 2).astype(float)
    shared = spark.sparkContext.broadcast((idf, base, known, label, 5, 0.5))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    (out,) = quality._vote(shared)([batch])
    for k in range(40):
        y = x[k] @ base
        s = known @ (y / np.linalg.norm(y))
        top = np.argsort(-s)[:5]
        w = s[top].clip(0) ** quality.SHARPNESS
        assert abs(out.column(1)[k].as_py() - ((w * label[top]).sum() + 0.005) / (w.sum() + 0.01)) < 1e-4


def test_counts_of_small_texts():
    (slab,) = slabs(pa.array(["aB1", "", "a a a a a a", None, "ab cd ab cd ab cd ab"]))
    x = quality.counts(slab)
    assert x[0].sum() == 1 and x[1].sum() == 0 and x[3].sum() == 0
    assert x[0, (0 * quality.CLASSES + 1) * quality.CLASSES + 2] == 1
    assert x[2, quality.TRIGRAMS :].sum() > 0 and x[4, quality.TRIGRAMS : quality.TRIGRAMS + 8].sum() == 0
    assert x[4, quality.TRIGRAMS + 8 :].sum() > 0


def test_empty_tables(table, labelled):
    docs, _, _ = labelled
    empty = table([], LABELS)
    assert quality.quality(table([], SCHEMA), empty).count() == 0
    assert {r.score for r in quality.quality(docs, empty).collect()} == {0.5}


def test_of_equal_similarities_the_first_columns_are_taken():
    rng = np.random.default_rng(5)
    close = rng.integers(0, 4, (200, 30)).astype(np.float32)
    close[0] = 1
    k = 7
    top = quality._first_of_ties(close, np.argpartition(-close, k - 1, axis=1)[:, :k].copy())
    for row, got in zip(close, top, strict=True):
        assert sorted(got) == sorted(sorted(range(30), key=lambda c: (-row[c], c))[:k])
    assert sorted(top[0]) == list(range(k))
