"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Method. A document is the weighted counts of its character-class trigrams (letter case, digits, spaces, line ends and
groups of punctuation) and of a few word patterns. Weights are logarithmic counts times the inverse document
frequency over all documents. A distributed randomised SVD of a bounded sample gives RANK latent directions. The
vectors of at most LABELLED labelled documents are broadcast; every document's cosine with each of them is computed
exactly, in blocks, and the NEIGHBOURS most similar vote for their labels, weighted by similarity.

Fitting reads the texts once for document frequencies (all documents) and a bounded sample for directions and
labelled vectors. Scoring is one pass without a shuffle; a task holds one slab of texts and one block of products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.latent import directions, sum_by_slice
from quire.llm.store import written
from quire.llm.toxicity import held_out, sample_labelled
from quire.llm.words import SLAB, Slab, slabs, word_hashes, words

LABELLED = 4096
RANK = 64
NEIGHBOURS = 15
ROWS = 256  # documents in a block of products
SHARPNESS = 8  # a neighbour's weight is its similarity to this power

_GROUPS = [
    bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\x0b\x0c\r", b"\n", b".", b",", b"!", b"?",
    b"|", b"#*$%&<>", b"'\"()[]{}", b"-_/\\+=~^`", b":;", b"@", bytes(range(128, 256)),
]
CLASSES = len(_GROUPS)
_CLASS = np.full(256, 12, np.int64)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _k
TRIGRAMS = CLASSES**3
PATTERNS = 16
FEATURES = TRIGRAMS + PATTERNS


def counts(slab: Slab) -> np.ndarray:
    """One row per document: trigrams of character classes, then word patterns; of unit length, zeros for empty texts."""
    n = slab.last - slab.first
    out = np.zeros((n, FEATURES), np.float32)
    kind = _CLASS[slab.data]
    doc = np.repeat(np.arange(n), np.diff(slab.bounds))
    if len(kind) > 2:
        same = doc[2:] == doc[:-2]
        code = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        out[:, :TRIGRAMS] = np.bincount(doc[2:][same] * TRIGRAMS + code[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    low = slab.lowered()
    found = words(low)
    if len(found.begin):
        hashes = word_hashes(low, found)
        total = found.counts()
        twice = np.zeros(len(hashes), bool)
        twice[1:] = (hashes[1:] == hashes[:-1]) & (found.doc[1:] == found.doc[:-1])
        pairs = np.zeros(len(hashes), np.uint64)
        pairs[1:] = hashes[1:] * np.uint64(31) + hashes[:-1]
        pairs[found.at[:-1][total > 0]] = np.arange((total > 0).sum(), dtype=np.uint64)
        order = np.lexsort((pairs, found.doc))
        again = np.zeros(len(hashes), bool)
        again[1:] = (pairs[order][1:] == pairs[order][:-1]) & (found.doc[order][1:] == found.doc[order][:-1])
        share = np.stack([
            np.bincount(found.doc[twice], minlength=n), np.bincount(found.doc[order][again], minlength=n),
        ], axis=1) / np.maximum(total, 1)[:, None]
        level = np.minimum((share * 8).astype(np.int64), 7)
        for k in range(2):  # a share of a text's words fills as many of eight steps
            steps = (np.arange(8)[None] <= level[:, k : k + 1]) & (share[:, k : k + 1] > 0.02)
            out[:, TRIGRAMS + 8 * k : TRIGRAMS + 8 * k + 8] = steps * total[:, None]
    return out


def vectors(slab: Slab, idf: np.ndarray) -> np.ndarray:
    x = counts(slab)
    size = np.maximum(x[:, :TRIGRAMS].sum(axis=1, keepdims=True), 1)
    x = np.log1p(x * (1000 / size)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _blocks(column: pa.Array) -> Iterator[Slab]:
    """Slabs of at most ROWS documents."""
    for first in range(0, len(column), ROWS):
        for slab in slabs(column.slice(first, ROWS), 2 * SLAB):
            yield Slab(slab.first + first, slab.last + first, slab.data, slab.bounds)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for slab in _blocks(batch.column(0)):
            x = counts(slab)
            total[:-1] += (x > 0).sum(axis=0)
            total[-1] += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["slice", "sums"])


def _sparse(shared):
    kinds = pa.schema([
        ("columns", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("label", pa.int32()), ("order", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in _blocks(batch.column(0)):
                x = vectors(slab, shared.value)
                cut = slice(slab.first, slab.last)
                filled = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([
                    pa.array(filled, pa.list_(pa.int64())),
                    pa.array([r[f].astype(np.float64) for r, f in zip(x, filled, strict=True)], pa.list_(pa.float64())),
                    batch.column(1)[cut].cast(pa.int32()), batch.column(2)[cut],
                ], schema=kinds)

    return run


def _first_of_ties(close: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The most similar columns of each row; of those as similar as the last one taken, the first columns."""
    least = np.take_along_axis(close, top, axis=1).min(axis=1, keepdims=True)
    for i in np.flatnonzero((close >= least).sum(axis=1) > top.shape[1]):
        above = np.flatnonzero(close[i] > least[i])
        top[i] = np.concatenate([above, np.flatnonzero(close[i] == least[i])[: top.shape[1] - len(above)]])
    return top


def _vote(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, base, known, label, neighbours, prior = shared.value
        for batch in batches:
            scores = []
            for slab in _blocks(batch.column(1)):
                y = vectors(slab, idf) @ base
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                if not len(known):
                    scores.append(np.full(len(y), prior))
                    continue
                close = y @ known.T
                k = min(neighbours, len(known))
                top = np.argpartition(-close, k - 1, axis=1)[:, :k]
                top = _first_of_ties(close, top)
                weight = np.take_along_axis(close, top, axis=1).clip(0).astype(np.float64) ** SHARPNESS
                scores.append(((weight * label[top]).sum(axis=1) + 0.01 * prior) / (weight.sum(axis=1) + 0.01))
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "score"])

    return run


def quality(
    docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, threshold: float = 0.7,
    labelled: int = LABELLED, rank: int = RANK, neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored. Labels are learned only from rows whose
    crc32(doc_id as text) modulo `parts` is not `part`, from about `labelled` of them at most (by a hash of doc_id,
    equal texts once); document frequencies cover all documents. Several labels of one document count as the largest.
    Null and empty texts have a zero vector and score the share of good labels, as does everything without labels.
    Of equal similarities the neighbours with the smallest text hashes vote. Repeated rows score alike, a null doc_id
    is not held out, an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = sum_by_slice(source.select("text").mapInArrow(_frequencies, "slice long, sums binary"), "<i8").collect()
    df = np.frombuffer(sums[0]["sums"], "<i8") if sums else np.zeros(FEATURES + 1, np.int64)
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.5).astype(np.float32)

    usable: Column = ~held_out(F.col("doc_id"), parts, part)
    known = sample_labelled(source, labels, "quality", usable, labelled).withColumn("order", F.xxhash64("text"))
    sparse = known.select("text", "label", "order").mapInArrow(
        _sparse(spark.sparkContext.broadcast(idf)), "columns array<long>, values array<double>, label int, order long"
    )
    sparse = written(sparse, "labelled")
    keys, found = directions(sparse, rank)
    base = np.zeros((FEATURES, found.shape[1]), np.float32)
    base[keys] = found
    rows = sorted(sparse.collect(), key=lambda r: r["order"])  # about `labelled` rows
    latent = np.zeros((len(rows), base.shape[1]), np.float32)
    for k, r in enumerate(rows):
        if r["columns"]:
            latent[k] = np.array(r["values"], np.float32) @ base[r["columns"]]
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    label = np.array([float(r["label"] > 0) for r in rows])
    prior = float((label.sum() + 1) / (len(label) + 2))
    shared = spark.sparkContext.broadcast((idf, base, latent, label, neighbours, prior))
    scored = source.mapInArrow(_vote(shared), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
