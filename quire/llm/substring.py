"""Substring deduplication with fixed-block anchors.

Method. Every document is cut into non-overlapping blocks of BLOCK words; the blocks are the index. Every window of
BLOCK words, wherever it begins, probes the index. A stretch of WINDOW >= 2 * BLOCK - 1 words contains a whole block
of its own document, so if it occurs twice, that block is hit by a probe of the other place. Hits are extended to
maximal exact repeats: where all blocks inside a window of WINDOW words are hit, the window's own hash is compared
with all others of that kind, and every window but the first in (doc_id, start) order marks its words. Marked
windows that overlap or touch join to one maximal span.

Index entries and probes are dealt to buckets by hash. A task sends each distinct probe, and each distinct index
entry, once, so a passage in very many documents is one entry per chunk of input. A chunk is a bounded slab of
documents; a task holds one chunk or one bucket, never a whole document group. What a bucket finds returns to the
chunk that asked, in one row, and is dealt to its documents there. Chunks are numbered by partition and place, so
docs must come from a table (or a checkpoint), where a task that runs again reads the same rows in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import shuffle_parts, small_enough, written
from quire.llm.words import SLAB, gram_hashes, gram_starts, slabs, word_hashes, words
from quire.llm.workers import releasing

WINDOW = 20
BLOCK = 10
CHUNK = 2 * SLAB
_LEAST = -(1 << 63)

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


_PLACES = [("chunk", pa.int64()), ("names", pa.binary()), ("sizes", pa.binary()), ("starts", pa.binary())]
_PLACES_SQL = "chunk long, names binary, sizes binary, starts binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("probes", pa.binary()), ("blocks", pa.binary()), *_PLACES])
_ENTRY = np.dtype([("mark", "<u4"), ("start", "<u4"), ("doc_id", "<i8"), ("many", "u1")])


def _places(names: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """names (documents: doc_id, copy; one row per start) and starts as blobs: each run of one document once."""
    change = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
    runs = np.concatenate([[0], change, [len(names)]])
    return names[runs[:-1]].astype("<i8").tobytes(), np.diff(runs).astype("<u4").tobytes(), starts.astype("<u4").tobytes()


def _unplaced(rows: list[pa.RecordBatch], at: int) -> tuple[np.ndarray, np.ndarray]:
    """names and starts of the blobs in the columns from `at` on."""
    blobs = [b"".join(b for r in rows for b in r.column(k).drop_null().to_pylist()) for k in range(at, at + 3)]
    names = np.frombuffer(blobs[0], "<i8").reshape(-1, 2)
    return np.repeat(names, np.frombuffer(blobs[1], "<u4"), axis=0), np.frombuffer(blobs[2], "<u4")


@releasing
def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that came back to one chunk, a row per document."""
    kinds = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("starts", pa.binary())])
    for rows in _groups(batches, 1):
        names, starts = _unplaced(rows, 1)
        if not len(names):
            continue
        order = np.lexsort((starts, names[:, 1], names[:, 0]))
        names, starts = names[order], starts[order]
        runs = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, [len(names)]])
        yield pa.RecordBatch.from_arrays([
            pa.array(names[runs[:-1], 0]), pa.array(names[runs[:-1], 1]),
            pa.array([starts[a:b].tobytes() for a, b in zip(runs[:-1], runs[1:], strict=True)], pa.binary()),
        ], schema=kinds)


def _returned(places: DataFrame) -> DataFrame:
    back = places.repartition("chunk").sortWithinPartitions("chunk")
    return back.mapInArrow(_by_document, "doc_id long, copy long, starts binary")


class _Chunks:
    """Numbers for the chunks of a task."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 32

    def take(self) -> int:
        self.next += 1
        return self.next


def _probe(block: int, buckets: int):
    """What each bucket is asked (probes, blocks), and what a chunk finds within itself (names, sizes, starts)."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks()
        for batch in batches:
            for slab in slabs(batch.column(1), CHUNK):
                doc_ids = batch.column(0).slice(slab.first, slab.last - slab.first).to_numpy(zero_copy_only=False)
                found = words(slab)
                at = gram_starts(found, block)
                grams = gram_hashes(word_hashes(slab, found), block)[at]
                # the bucket above, a 32-bit mark below: a chance match only adds a candidate
                keys = ((grams >> _32) % np.uint64(buckets) << _32) | (grams & _LOW)
                own = at - found.at[found.doc[at]]
                aligned = own % block == 0
                probes = np.unique(keys[~aligned])
                at, own, entry = at[aligned], own[aligned], keys[aligned]
                order = np.argsort(entry, kind="stable")
                at, own, entry = at[order], own[order], entry[order]
                runs = _cuts(entry)
                many = np.diff(runs) > 1
                first = runs[:-1]
                inside = np.sort(at[np.repeat(many, np.diff(runs)) | np.isin(entry, probes)])
                doc = found.doc[inside]
                names = np.stack([doc_ids[doc], np.zeros(len(doc), np.int64)], axis=1)
                known = _places(names, inside - found.at[doc]) if len(inside) else None
                yield _to_buckets(
                    probes, entry[first], own[first], doc_ids[found.doc[at[first]]], many, buckets, chunks.take(), known
                )

    return run


def _to_buckets(probes, entry, start, doc_id, many, buckets, chunk, known) -> pa.RecordBatch:
    packed = np.empty(len(entry), _ENTRY)
    packed["mark"], packed["start"], packed["doc_id"], packed["many"] = entry & _LOW, start, doc_id, many
    marks = (probes & _LOW).astype("<u4")
    edges = np.arange(buckets + 1, dtype=np.uint64) << _32
    p, e = np.searchsorted(probes, edges), np.searchsorted(entry, edges)
    rows = [
        (b, marks[p[b] : p[b + 1]].tobytes(), packed[e[b] : e[b + 1]].tobytes(), chunk, None, None, None)
        for b in range(buckets) if p[b] < p[b + 1] or e[b] < e[b + 1]
    ]
    if known:
        rows.append((chunk % buckets, None, None, chunk, *known))
    columns = zip(*rows, strict=True) if rows else [()] * len(_ASKED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ASKED, strict=True)], schema=_ASKED)


@releasing
def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket per group of rows: index entries that a probe or another entry meets, a row for each chunk."""
    kinds = pa.schema(_PLACES)
    for rows in _groups(batches, 1):
        for r in rows:
            known = r.filter(pc.is_valid(r.column(4)))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays(known.columns[3:], schema=kinds)
        blobs = [(c, b) for r in rows for c, b in zip(r.column(3).to_pylist(), r.column(2).to_pylist(), strict=True) if b]
        entries = np.frombuffer(b"".join(b for _, b in blobs), _ENTRY)
        chunk = np.repeat([c for c, _ in blobs], [len(b) // _ENTRY.itemsize for _, b in blobs]).astype(np.int64)
        marks = np.frombuffer(b"".join(b for r in rows for b in r.column(1).drop_null().to_pylist()), "<u4")
        values, times = np.unique(entries["mark"], return_counts=True)
        met = np.isin(values, marks) | (times > 1)
        met[np.searchsorted(values, entries["mark"][entries["many"] > 0])] = True
        hit = met[np.searchsorted(values, entries["mark"])]
        entries, chunk = entries[hit], chunk[hit]
        order = np.lexsort((entries["start"], entries["doc_id"], chunk))
        entries, chunk = entries[order], chunk[order]
        out = []
        for a, b in zip((cuts := _cuts(chunk))[:-1], cuts[1:], strict=True):
            own = entries[a:b]
            names = np.stack([own["doc_id"], np.zeros(len(own), np.int64)], axis=1)
            out.append((int(chunk[a]), *_places(names, own["start"])))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds
            )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows that agree in the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(values[:, a])
            if held and own != last:
                yield held
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield held


_DONE = [
    ("doc_id", pa.int64()), ("copy", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("kept_sha256", pa.string()), ("kept_text", pa.large_binary()), ("spans", pa.list_(pa.int64())),
]
_OPEN = pa.schema([
    *_DONE, ("source", pa.large_binary()), ("local", pa.binary()), ("bucket", pa.int32()), *_PLACES, ("keys", pa.binary()),
])
_DONE_SQL = "doc_id long, copy long, n_words long, n_removed long, kept_sha256 string, kept_text binary, spans array<long>"
_OPEN_SQL = f"{_DONE_SQL}, source binary, local binary, bucket int, {_PLACES_SQL}, keys binary"


def _finish(text: bytes, starts: np.ndarray, window: int, with_text: bool) -> tuple:
    """n_words, n_removed, digest, text and spans of a document whose windows at `starts` go."""
    found = text.split()
    n = len(found)
    if not len(starts):
        digest = hashlib.sha256(b" ".join(found)).hexdigest()
        return n, 0, digest, None, []
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    gone = np.cumsum(change)[:n] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    spans = edges.reshape(-1, 2)
    kept = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
    digest = hashlib.sha256(b" ".join(kept)).hexdigest()
    left = None
    if with_text:
        (slab,) = slabs(pa.array([text], pa.large_binary()))
        place = words(slab)
        pieces, last = [], 0
        for a, b in [*spans.tolist(), [n, n]]:
            if a > last:
                pieces.append(text[place.begin[last] : place.end[a - 1]])
            last = b
        left = b"\n".join(pieces)
    return n, int(gone.sum()), digest, left, spans.ravel().tolist()


def _extend(window: int, block: int, buckets: int, with_text: bool):
    """Documents without candidate windows are finished; the others go on with their windows' hashes by bucket."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks()
        for batch in batches:
            for slab in slabs(batch.column(2), CHUNK):
                cut = batch.slice(slab.first, slab.last - slab.first)
                yield from _extend_slab(cut, slab, window, block, buckets, with_text, chunks.take())

    return run


def _extend_slab(batch, slab, window, block, buckets, with_text, chunk):
    n = batch.num_rows
    hits = batch.column(3).to_pylist()
    names = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
    candidate = np.zeros(0, np.int64)
    if any(h is not None for h in hits):
        found = words(slab)
        hit = np.zeros(len(found.doc) + window, bool)
        for d, h in enumerate(hits):
            for blob in h or ():
                s = found.at[d] + np.frombuffer(blob, "<u4").astype(np.int64)
                hit[s[s < found.at[d + 1]]] = True
        starts = gram_starts(found, window)
        own = starts - found.at[found.doc[starts]]
        first = starts + (-own) % block  # the first block of the window; further ones follow at `block` words
        good = np.ones(len(starts), bool)
        for k in range(0, window - block + 1, block):
            good &= hit[np.minimum(first + k, len(hit) - 1)] | (first + k > starts + window - block)
        candidate = starts[good]
    local = [b""] * n
    open_docs = np.zeros(n, bool)
    if len(candidate):
        doc = found.doc[candidate]
        open_docs[doc] = True
        keys = gram_hashes(word_hashes(slab, found), window)[candidate]
        place = candidate - found.at[doc]
        order = np.lexsort((place, names[doc, 1], names[doc, 0], keys))
        again = np.zeros(len(order), bool)
        again[1:] = keys[order][1:] == keys[order][:-1]
        later = np.sort(order[again])
        for d in np.unique(doc[later]):
            local[d] = place[later][doc[later] == d].astype("<u4").tobytes()
        sent = np.sort(order[~again])
        doc, keys, place = doc[sent], keys[sent], place[sent]
    rows = []
    raw = slab.data
    for d in range(n):
        text = raw[slab.bounds[d] : slab.bounds[d + 1]].tobytes()
        if open_docs[d]:
            rows.append((*names[d].tolist(), None, None, None, None, None, text, local[d], *[None] * 6))
        else:
            none = np.zeros(0, np.int64)
            rows.append((*names[d].tolist(), *_finish(text, none, window, with_text), *[None] * 8))
    if len(candidate):
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, doc, keys, place = bucket[order], doc[order], keys[order], place[order]
        cuts = _cuts(bucket)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            places = _places(names[doc[a:b]], place[a:b])
            rows.append((*[None] * 9, int(bucket[a]), chunk, *places, keys[a:b].tobytes()))
    for k in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 2000], strict=True), _OPEN, strict=True)], schema=_OPEN
        )


def _plain(with_text: bool):
    kinds = pa.schema(_DONE)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = [
                    (doc_id, copy, *_finish(text, none, 1, with_text))
                    for doc_id, copy, text in zip(*(c.to_pylist() for c in batch.slice(k, 1000).columns), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds
                )

    return run


@releasing
def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket per group of rows: windows whose words also begin earlier, a row for each chunk."""
    kinds = pa.schema(_PLACES)
    for rows in _groups(batches, 1):
        names, start = _unplaced(rows, 2)
        blobs = [(c, b) for r in rows for c, b in zip(r.column(1).to_pylist(), r.column(5).to_pylist(), strict=True)]
        keys = np.frombuffer(b"".join(b for _, b in blobs), "<u8")
        chunk = np.repeat([c for c, _ in blobs], [len(b) // 8 for _, b in blobs]).astype(np.int64)
        order = np.lexsort((start, names[:, 1], names[:, 0], keys))
        again = np.zeros(len(order), bool)
        again[1:] = keys[order][1:] == keys[order][:-1]
        later = np.sort(order[again])  # in the order of the blobs: by chunk, then by document
        out = []
        for a, b in zip((cuts := _cuts(chunk[later]))[:-1], cuts[1:], strict=True):
            out.append((int(chunk[later[a]]), *_places(names[later[a:b]], start[later[a:b]])))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds
            )


def _close(window: int, with_text: bool):
    kinds = pa.schema(_DONE)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, copy, text, local, blobs in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    starts = np.frombuffer(b"".join([local, *(blobs or ())]), "<u4").astype(np.int64)
                    rows.append((doc_id, copy, *_finish(text, np.unique(starts), window, with_text)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds
                )

    return run


def _named(docs: DataFrame) -> DataFrame:
    """doc_id (the smallest number for null) and copy (a hash of the text): together the name of a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.xxhash64(text).alias("copy"),
        text.alias("text"),
    )


def _judged(named: DataFrame, window: int, block: int, with_text: bool) -> DataFrame:
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it begins: window >= 2 * block - 1")
    buckets = shuffle_parts(named)
    asked = named.select("doc_id", "text").mapInArrow(
        _probe(block, buckets), f"bucket int, probes binary, blocks binary, {_PLACES_SQL}"
    )
    hits = _returned(asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_match, _PLACES_SQL))
    hits = written(hits.groupBy("doc_id").agg(F.collect_list("starts").alias("hits")), "hits")  # bounded by a document

    met = small_enough(hits.select("doc_id"))  # documents without a hit need no shuffle of their texts
    single = named.join(met, "doc_id", "left_semi").groupBy("doc_id", "copy").agg(F.first("text").alias("text"))
    extended = single.join(hits, "doc_id").select("doc_id", "copy", "text", "hits")
    extended = written(extended.mapInArrow(_extend(window, block, buckets, with_text), _OPEN_SQL), "windows")
    windows = extended.filter("bucket IS NOT NULL").select("bucket", "chunk", "names", "sizes", "starts", "keys")
    later = _returned(windows.repartitionById(buckets, F.col("bucket")).mapInArrow(_later, _PLACES_SQL))
    later = later.groupBy("doc_id", "copy").agg(F.collect_list("starts").alias("gone"))  # bounded by a document
    closed = (
        extended.filter("source IS NOT NULL").select("doc_id", "copy", "source", "local")
        .join(later, ["doc_id", "copy"], "left")
        .select("doc_id", "copy", "source", "local", "gone")
        .mapInArrow(_close(window, with_text), _DONE_SQL)
    )
    done = extended.filter("n_words IS NOT NULL").select(*(f[0] for f in _DONE))
    plain = named.join(met, "doc_id", "left_anti").mapInArrow(_plain(with_text), _DONE_SQL)
    plain = plain.dropDuplicates(["doc_id", "copy"])  # short rows that repeat
    return written(done.unionByName(closed).unionByName(plain), "repeats")


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, spans per row of docs.

    docs: doc_id, text; other columns are ignored. Words are runs of bytes other than space and 0x09-0x0D, unchanged.
    Each word covered by a window of `window` words that also begins earlier (smaller doc_id, or same document and
    earlier start) goes; windows are judged on the input. kept_sha256 digests the kept words joined by one space;
    kept_text holds the kept stretches joined by line breaks, null where nothing goes (and without with_text). spans:
    begin and end word of each removed span, flat. A null text has no words. Rows that agree in doc_id and text are
    one document and get equal results; rows of one doc_id with different texts are ordered by a hash of the text. A
    null doc_id comes before all others. An empty table gives no rows.
    """
    named = _named(docs)
    out = named.select("doc_id", "copy").join(_judged(named, window, block, with_text), ["doc_id", "copy"])
    return out.select(
        F.when(F.col("doc_id") != _LEAST, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256",
        F.col("kept_text").cast("string").alias("kept_text"), "spans",
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows and columns of docs, with repeats cut out of text; see remove_repeats."""
    changed = _judged(_named(docs), window, block, True).filter("n_removed > 0").select(
        F.col("doc_id").alias("_name"), F.col("copy").alias("_copy"), F.col("kept_text").alias("_kept")
    )
    names = small_enough(written(changed.select("_name", "_copy"), "changed"))
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST))
    copy = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    unchanged = (own == names["_name"]) & (copy == names["_copy"])
    some = docs.join(names, unchanged, "left_semi")
    same = (F.coalesce(some["doc_id"].cast("long"), F.lit(_LEAST)) == changed["_name"]) & (
        F.xxhash64(F.coalesce(some["text"].cast("string"), F.lit("")).cast("binary")) == changed["_copy"]
    )
    cut = some.join(changed, same).select(
        *(changed["_kept"].cast("string").alias("text") if c == "text" else some[c] for c in docs.columns)
    )
    return docs.join(names, unchanged, "left_anti").withColumn("text", F.col("text").cast("string")).unionByName(cut)
