"""Benchmark decontamination by latent semantic retrieval.

Method. Words are hashed to FEATURES columns and weighted by their inverse document frequency over all documents
(words in more than COMMON of the documents weigh nothing). The benchmark's passages, in blocks of about ITEMS, form
TF-IDF matrices whose right singular directions come from a distributed randomised SVD: random projection, power
iterations and a final small eigenproblem, with the products summed by Spark. A block keeps as many directions as it
has passages, so its passages lie wholly in the latent space and products there are those of the full vectors. Every
document is read as overlapping windows of WINDOW segments; each is folded into the latent space and its product with
every benchmark passage is computed in blocks. Candidates are checked on their words: the longest common subsequence
of content words, and, for paraphrases that share less, the item's closing words as its answer.

Frequencies can't tell a stop word from a word of an item that leaked into many documents. So an item with few content
words, by number or by share, is plain: its passages stand in blocks of their own where every word weighs 1, and it is
checked on all its words in a stretch of about its own length, whatever their frequencies.

The gate follows from that check. Whatever else stands in a window, its product with a passage is at least the sum
of the squared weights of the words they share, and the check needs a share of the item's words; so a passage
becomes a candidate from the least sum that such a share of its words can have (`least_product`). Of the candidates,
those go to the check whose window has that share of the passage's words, each as often as in both. A stretch of
(WINDOW - 1) * SEGMENT words lies in one window whole, so no copy or paraphrase as long as that is lost before the check.

Documents are read once for GROUP blocks, so what is broadcast is bounded: GROUP * ITEMS passages of PASSAGE words
with their vectors, and one weight for each of the FEATURES columns (an item's passages stay in one block, so a block
holds at least its longest item). Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.latent import directions, sum_by_slice
from quire.llm.store import small_enough, written
from quire.llm.toxicity import cores
from quire.llm.words import SLAB, Slab, slabs, span_hashes, words
from quire.llm.workers import releasing

FEATURES = 1 << 18
SLICE = 1 << 10
COMMON = 0.05
#: A passage has at most PASSAGE words; a window has WINDOW segments and begins at every segment.
PASSAGE = 48
SEGMENT, WINDOW = 32, 3
#: Latent cosines of finds lie above this; it decides nothing.
COSINE = 0.3
ITEMS, GROUP = 256, 16
#: Shares of an item's content words that must stand in the document in order: alone, and with the answer there too.
COPIED, PARAPHRASED, ANSWERED = 0.6, 0.35, 0.75
#: An item is plain with fewer content words than FEW_WORDS, or a smaller share of them than FEW_CONTENT. Of its words
#: COPIED must stand in order, FEW_SHARE of an item under SHORT words, in a stretch longer than the item by a quarter.
FEW_WORDS, FEW_CONTENT, FEW_SHARE, SHORT = 6, 1 / 3, 0.8, 12


def _features(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash and document of each word without punctuation around it, and each document's first word."""
    low = slab.lowered()
    found = words(low)
    begin, end = cores(low, found)
    full = end > begin
    return span_hashes(low.data, begin[full], end[full]), found.doc[full], np.concatenate(
        [[0], np.cumsum(np.bincount(found.doc[full], minlength=slab.last - slab.first))]
    )


def _column(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FEATURES - 1)).astype(np.int64)


@releasing
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for slab in slabs(batch.column(0), 2 * SLAB):
            hashes, doc, at = _features(slab)
            both = np.unique(doc * FEATURES + _column(hashes))
            counts += np.bincount(both % FEATURES, minlength=FEATURES)
            texts += int((np.diff(at) > 0).sum())
    parts = [counts[k : k + SLICE].tobytes() for k in range(0, FEATURES, SLICE)] + [np.array([texts]).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], names=["slice", "sums"])


def document_weights(docs: DataFrame, common: float = COMMON) -> np.ndarray:
    """The inverse document frequency of each feature over all documents, 0 for common ones; FEATURES numbers."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    partial = text.mapInArrow(_frequencies, "slice long, sums binary")
    rows = {r[0]: r[1] for r in sum_by_slice(partial, "<i8").collect()}  # FEATURES numbers
    slices = FEATURES // SLICE
    if not rows:
        return np.ones(FEATURES, np.float32)
    n = max(1, int(np.frombuffer(rows[slices], "<i8")[0]))
    df = np.concatenate([np.frombuffer(rows[k], "<i8") for k in range(slices)])
    idf = np.log((n + 1) / (df + 0.5))
    return np.where(df > common * n, 0, idf).clip(0).astype(np.float32)


def _parts(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, low, high) of parts of even size and at most `length` words that make up each text."""
    n = np.diff(at)
    count = -(-n // length)
    which = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return which, at[which] + k * n[which] // count[which], at[which] + (k + 1) * n[which] // count[which]


def _segments(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, low, last) of each text's segments of SEGMENT words; last is the last segment of the window begun there."""
    n = np.diff(at)
    count = -(-n // SEGMENT)
    which = np.repeat(np.arange(len(n)), count)
    ends = np.cumsum(count)
    k = np.arange(count.sum())
    return which, at[which] + (k - (ends - count)[which]) * SEGMENT, np.minimum(k + WINDOW, ends[which]) - 1


def common_length(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over the item's positions."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def is_plain(item_weight: np.ndarray) -> bool:
    content = int((item_weight > 0).sum())
    return content < FEW_WORDS or content < FEW_CONTENT * len(item_weight)


def plain_share(words: int) -> float:
    return FEW_SHARE if words < SHORT else COPIED


def judge_plain(item: np.ndarray, text: np.ndarray) -> tuple[int, int, bool]:
    """(common words, words compared, whether the text holds the item) over all words, in the best short stretch."""
    span = len(item) + max(2, len(item) // 4)
    needed = plain_share(len(item)) * len(item)
    hits = np.isin(text, item)
    counts = np.concatenate([[0], np.cumsum(hits)])
    starts = np.flatnonzero(hits)
    starts = starts[counts[np.minimum(starts + span, len(text))] - counts[starts] >= needed]
    best = max((common_length(item, text[s : s + span]) for s in starts.tolist()), default=0)
    return best, len(item), best > 0 and best >= needed


def judge(item: np.ndarray, item_weight: np.ndarray, text: np.ndarray, text_weight: np.ndarray) -> tuple[int, int, bool]:
    """(common words, words compared, whether the text holds the item)."""
    if is_plain(item_weight):
        return judge_plain(item, text)
    own, other = item[item_weight > 0], text[text_weight > 0]
    n = common_length(own, other)
    if n >= COPIED * len(own):
        return n, len(own), True
    if n < PARAPHRASED * len(own):
        return n, len(own), False
    answer = own[-max(3, len(own) // 4) :]
    return n, len(own), common_length(answer, other) >= ANSWERED * len(answer)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("cosine", pa.float64()),
    ("common_words", pa.int64()), ("item_words", pa.int64()),
])


def least_product(weight: np.ndarray, share: float) -> float:
    """The least product with its passage of a text that shares so many of its words with a weight.

    weight: of the passage's words. A text with a share of an item's words has it of one of its passages at least.
    """
    squares = np.sort(weight[weight > 0].astype(np.float64) ** 2)
    return float(squares[: int(np.ceil(share * len(squares) - 1e-9))].sum())


def _near(hashes: np.ndarray, weight: np.ndarray, low: np.ndarray, last: np.ndarray, model) -> Iterator[tuple]:
    """(segments, passages, cosines): the windows, by their first segment, that reach a passage's least product."""
    keys, vectors, latent, least, times, needed, _, _ = model
    column = _column(hashes)
    place = np.searchsorted(keys, column).clip(0, len(keys) - 1)
    known = np.flatnonzero((keys[place] == column) & (weight > 0))
    segment = np.searchsorted(low, known, "right") - 1
    norms = np.linalg.norm(latent, axis=1).clip(1e-9)
    for first in range(0, len(low), 2048):
        end = min(first + 2048, len(low))
        stop = int(last[first:end].max()) + 1
        a, b = np.searchsorted(segment, [first, stop])
        if a == b:
            continue
        own = known[a:b]
        full, starts = np.unique(segment[a:b], return_index=True)
        folded = np.zeros((stop - first, vectors.shape[1]), np.float32)
        folded[full - first] = np.add.reduceat(vectors[place[own]] * weight[own, None], starts, axis=0)
        window = folded[: end - first].copy()
        for k in range(1, WINDOW):
            more = np.flatnonzero(np.arange(first, end) + k <= last[first:end])
            window[more] += folded[more + k]
        busy = np.flatnonzero(window.any(axis=1))
        product = window[busy] @ latent.T
        p, k = np.nonzero(product >= least)
        low_of = np.searchsorted(segment[a:b], first + busy[p])
        n = np.searchsorted(segment[a:b], last[first + busy[p]], "right") - low_of  # a busy window has known words
        good = np.zeros(len(p), bool)
        for c in range(0, len(p), 16384):
            m, l = n[c : c + 16384], low_of[c : c + 16384]
            at = np.repeat(l - np.cumsum(m) + m, m) + np.arange(m.sum())
            own_k, which = k[c : c + 16384], np.repeat(np.arange(len(m)), m)
            common = times[own_k[which], place[own[at]]] > 0
            enough = np.bincount(which[common], minlength=len(m)) >= needed[own_k]
            common &= enough[which]
            pairs, often = np.unique(which[common] * len(keys) + place[own[at[common]]], return_counts=True)
            which, found = np.divmod(pairs, len(keys))
            both = np.minimum(often, times[own_k[which], found])
            good[c : c + 16384] = np.bincount(which, both, minlength=len(m)) >= needed[own_k]
        p, k = p[good], k[good]
        size = np.linalg.norm(window[busy[p]], axis=1).clip(1e-9)
        yield first + busy[p], k, product[p, k] / size / norms[k]


def _search(shared):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, models, items = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for slab in slabs(batch.column(1)):
                hashes, _, at = _features(slab)
                weight = weights[_column(hashes)]
                which, low, last = _segments(at)
                high = np.minimum(low + SEGMENT, at[which + 1])
                hits: dict[tuple[int, int], list] = {}
                for model in models:
                    given = np.ones_like(weight) if model[-1] else weight
                    for segments, passages, cosines in _near(hashes, given, low, last, model):
                        for q, k, c in zip(segments.tolist(), passages.tolist(), cosines.tolist(), strict=True):
                            key = (int(which[q]), int(model[-2][k]))
                            hits.setdefault(key, []).append((int(low[q]), int(high[last[q]]), c))
                rows = []
                for (d, k), places in hits.items():
                    words_of = items[k][0]
                    words_weight = weights[_column(words_of)]
                    reach = len(words_of) + SEGMENT
                    best = None
                    for s, e, c in places:
                        s2, e2 = max(at[d], s - reach), min(at[d + 1], e + reach)
                        n, m, good = judge(words_of, words_weight, hashes[s2:e2], weight[s2:e2])
                        if good and (best is None or n > best[4]):
                            best = (ids[slab.first + d], items[k][1], int(s - at[d]), c, n, m)
                    if best:
                        rows.append(best)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT
                    )

    return run


def _cut_items(shared):
    """Every item's passages: weighted features of unit length, their least product, and all the item's words."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for slab in slabs(batch.column(1)):
                hashes, _, at = _features(slab)
                for d, a, b in zip(*(x.tolist() for x in _parts(at, PASSAGE)), strict=True):
                    whole = hashes[at[d] : at[d + 1]]
                    plain = is_plain(weights[_column(whole)])
                    given = np.ones_like(weights) if plain else weights
                    share = plain_share(len(whole)) if plain else PARAPHRASED
                    columns, times = np.unique(_column(hashes[a:b]), return_counts=True)
                    values = given[columns].astype(np.float64) * times
                    norm = max(np.linalg.norm(values), 1e-300)
                    least = least_product(given[_column(hashes[a:b])], share) / norm
                    needed = int(np.ceil(share * times[values > 0].sum() - 1e-9))
                    rows.append((
                        ids[slab.first + d], plain, columns.tolist(), (values / norm).tolist(), times.tolist(), least, needed,
                        whole.view(np.int64).tolist(),
                    ))
            if rows:
                i, p, c, v, t, x, m, w = zip(*rows, strict=True)
                longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(i, pa.int64()), pa.array(p, pa.bool_()), pa.array(c, longs), pa.array(v, doubles),
                        pa.array(t, longs), pa.array(x, pa.float64()), pa.array(m, pa.int64()), pa.array(w, longs),
                    ],
                    names=["item_id", "plain", "columns", "values", "times", "least", "needed", "words"],
                )

    return run


_FOUND = "doc_id long, item_id long, start long, cosine double, common_words long, item_words long"


def contaminated(docs: DataFrame, benchmark: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, item_id, start, cosine, common_words, item_words: one row for each document and item that it holds.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are lower-cased and stripped of
    punctuation. start is the word at which the window of the best match begins, cosine that window's with the
    passage in the latent space. Null and empty texts hold nothing and are held by nothing; a null doc_id or item_id
    stays null in the result; items of equal text each match; repeated documents each come out; an empty table on
    either side gives no rows. Items with few content words are compared by all their words, so an item is found however
    many documents hold it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if weights is None:
        weights = document_weights(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = items.mapInArrow(
        _cut_items(spark.sparkContext.broadcast(weights)),
        "item_id long, plain boolean, columns array<long>, values array<double>, times array<long>, least double, needed long, "
        "words array<long>",
    )
    cut = written(cut, "benchmark-passages")
    sizes = {r["plain"]: -(-r["count"] // ITEMS) for r in cut.groupBy("plain").count().collect()}
    blocks = [(plain, block) for plain, size in sorted(sizes.items()) for block in range(size)]
    found = None
    for first in range(0, len(blocks), GROUP):
        models, names, listed = [], {}, []
        for plain, block in blocks[first : first + GROUP]:
            # The passages of an item stay together, so each pass over the documents finds an item once.
            dealt = F.pmod(F.xxhash64("item_id", "words"), F.lit(sizes[plain])) == block
            own = cut.filter((F.col("plain") == plain) & dealt)
            rows = own.collect()
            keys, vectors = directions(own, len(rows)) if rows else ((), None)
            if not len(keys) or not vectors.shape[1]:
                continue
            latent = np.zeros((len(rows), vectors.shape[1]), np.float32)
            item_of = np.zeros(len(rows), np.int64)
            times = np.zeros((len(rows), len(keys)), np.int8)  # at most PASSAGE
            for r, row in enumerate(rows):
                at = np.searchsorted(keys, row["columns"])
                latent[r] = np.array(row["values"]) @ vectors[at]
                times[r, at] = row["times"]
                words_of = np.array(row["words"], np.int64)
                item_of[r] = names.setdefault((row["item_id"], words_of.tobytes()), len(listed))
                if item_of[r] == len(listed):
                    listed.append((words_of.view(np.uint64), row["item_id"]))
            least = np.array([0.999 * row["least"] for row in rows], np.float32)  # rounding
            least[least <= 0] = np.inf  # no word with a weight
            needed = np.array([row["needed"] for row in rows])
            models.append((keys, vectors, latent, least, times, needed, item_of, plain))
        if not models:
            continue
        shared = spark.sparkContext.broadcast((weights, models, listed))
        part = docs.mapInArrow(_search(shared), _FOUND)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], _FOUND) if found is None else found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item; rows without doc_id stay."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_id")).distinct()
    found = small_enough(written(found, "contaminated"))
    return docs.join(found, docs["doc_id"].cast("long") == found["_id"], "left_anti")
