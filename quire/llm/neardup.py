"""MinHash near-duplicates by an inverted join over signature coordinates.

Method. A document is its set of word shingles, and a signature of COORDINATES minima of that set. Documents with
equal sets form a class; only one document of a class goes on. A class is posted under each (coordinate, value) pair
of its signature. Two sets whose similarity reaches the threshold agree on at least MATCHES coordinates (a binomial
tail; see `near_duplicates`), so, with a class's pairs ordered from the rarest on, any two such classes meet under
one of their first COORDINATES - MATCHES + 1 pairs (prefix), and classes with enough pairs of their own are skipped
at once. Collisions are counted on whole signatures, and only pairs that reach MATCHES are compared by their sets.

Posting lists may hold many near copies, so pairs are not expanded. First every class of a list is compared with the
list's first class, which ties large groups together in linear work. Lists of more than BLOCK classes that still span
several components go on with other hubs, drawn anew in each turn, as long as that ties more. Then only lists that
still span several components are compared in blocks of BLOCK classes; the blocks of a list's largest component meet
the list's other classes, not each other, so the copies of a large group are not dealt in the square of their number.
A block passes over classes of one component, takes each pair
only under the first prefix pair that both have, compares the sets themselves (SKETCH hashes, whole for shorter
documents) and joins what is surely linked at once, so it returns a spanning forest and few doubtful pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.store import small_enough, written
from quire.llm.words import Slab, gram_hashes, gram_starts, mix, slabs, word_hashes, words
from quire.llm.workers import releasing

SHINGLE = 5
COORDINATES = 48
MATCHES = 24
BLOCK = 512
SKETCH = 1024
TURNS = 6  # of hubs in long lists; what they leave apart is compared in blocks

_FACTORS = np.random.default_rng(48).integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches_for(percent: int, coordinates: int = COORDINATES, missed: float = 1e-8) -> int:
    """The most coordinates that sets of that similarity share but for a chance of `missed`."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > missed:
            return k
    return coordinates


def shingle_sets(slab: Slab, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the slab's documents, sorted within each, and where each document's begin.

    A document with fewer words than a shingle is one shingle of all of them; one without words has none.
    """
    low = slab.lowered()
    found = words(low)
    hashes = word_hashes(low, found)
    starts = gram_starts(found, size)
    grams, doc = gram_hashes(hashes, size)[starts], found.doc[starts]
    counts = found.counts()
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        short = gram_hashes(hashes[found.at[d] : found.at[d + 1]], int(counts[d]))
        grams, doc = np.append(grams, short), np.append(doc, d)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(slab.last - slab.first + 1))


def signatures(grams: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """The minima of `coordinates` hash functions over each set; sets must not be empty."""
    out = np.empty((len(at) - 1, coordinates), np.int32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat((grams * _FACTORS[k] >> np.uint64(32)).astype(np.uint32), at[:-1]).view(np.int32)
    return out


def _describe(shingle: int, coordinates: int):
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()),
        ("signature", pa.list_(pa.int32())),
    ])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(1)):
                grams, at = shingle_sets(slab, shingle)
                n = np.diff(at)
                full = n > 0
                sums = np.zeros((2, len(n)), np.int64)
                sig = np.zeros((0, coordinates), np.int32)
                if full.any():
                    starts = at[:-1][full]
                    sums[0, full] = np.add.reduceat(mix(grams), starts).view(np.int64)
                    sums[1, full] = np.add.reduceat(mix(grams * _FACTORS[-1]), starts).view(np.int64)
                    sig = signatures(grams, np.append(starts, len(grams)), coordinates)
                ends = np.concatenate([[0], np.cumsum(full * coordinates)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(slab.first, slab.last - slab.first), pa.array(n), pa.array(sums[0]),
                    pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel())),
                ], schema=kinds)

    return run


def describe(docs: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, key_a and key_b (equal for equal sets), signature (empty for an empty set)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(
        _describe(shingle, coordinates),
        "doc_id long, n_shingles long, key_a long, key_b long, signature array<int>",
    )


def postings(classes: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """token, df, node, mask: the prefix of each class, its rarest coordinate-value pairs that others have too.

    mask has a bit for every coordinate in the class's prefix (coordinates must fit 63 bits).
    """
    posted = classes.select("node", F.posexplode("signature").alias("k", "value")).select(
        "node", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("value")).alias("token")
    )
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    met = posted.join(shared, "token").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("met")  # at most `coordinates` entries
    )
    room = F.size("met") - (matches - 1)  # the prefix without the pairs that no other class has
    prefix = met.filter(room > 0).select("node", F.slice("met", F.lit(1), room).alias("prefix"))
    bit = "shiftleft(1L, cast(shiftright(p.token + 2147483648L, 32) as int))"  # the low half of a token is signed
    mask = F.expr(f"aggregate(prefix, 0L, (m, p) -> m | {bit})")
    return prefix.select("node", mask.alias("mask"), F.explode("prefix").alias("p")).select(
        "p.token", "p.df", "node", "mask"
    )


def _similar(percent: int, shingle: int):
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(column: pa.Array) -> np.ndarray:
        """(row, shingle) as one structured array, sorted and distinct."""
        rows, grams = [], []
        for slab in slabs(column):
            g, at = shingle_sets(slab, shingle)
            grams.append(g)
            rows.append(np.repeat(np.arange(slab.first, slab.last), np.diff(at)))
        return np.concatenate(rows), np.concatenate(grams)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                (row_a, gram_a), (row_b, gram_b) = sets(batch.column(2)), sets(batch.column(3))
                n = batch.num_rows
                rows, grams = np.concatenate([row_a, row_b]), np.concatenate([gram_a, gram_b])
                order = np.lexsort((grams, rows))
                rows, grams = rows[order], grams[order]
                twice = (rows[1:] == rows[:-1]) & (grams[1:] == grams[:-1])
                common = np.bincount(rows[1:][twice], minlength=n)
                union = np.bincount(rows, minlength=n) - common
                good = pa.array(100 * common >= percent * union)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(good), batch.column(1).filter(good)], schema=kinds
                )

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; texts: node, text."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(percent, shingle), "a long, b long")


def _sketch(shingle: int):
    """The SKETCH smallest 32-bit shingle hashes of each text, sorted; all of them if there are no more."""
    kinds = pa.schema([("node", pa.int64()), ("sketch", pa.binary())])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(1)):
                grams, at = shingle_sets(slab, shingle)
                small = (grams >> np.uint64(32)).astype("<u4")  # sorted within each document as grams are
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(slab.first, slab.last - slab.first),
                    pa.array([small[a : min(b, a + SKETCH)].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]),
                ], schema=kinds)

    return run


class _Forest:
    """Union-find over the nodes of a block, begun with their components."""

    def __init__(self, component: np.ndarray):
        self.part = np.unique(component, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.part[self.part == self.part[j]] = self.part[i]


def _pairs_of_block(t: dict, coordinates: int, matches: int, percent: int) -> list[tuple[int, int]]:
    """Links of one list's block, or of two blocks with each other: certain ones as a forest, doubtful ones as pairs."""
    node, side, sig = t["node"], t["block"], t["signature"]
    own = (np.array([t["mask"]]).T >> np.arange(coordinates) & 1).astype(bool).reshape(len(node), coordinates)
    coordinate = (t["token"] + (1 << 31)) >> 32
    sizes = np.array([len(x) for x in t["sketch"]])
    ends = np.cumsum(sizes)
    grams, ids = np.unique(np.concatenate(t["sketch"]), return_inverse=True)
    forest = _Forest(t["component"])
    flags = np.zeros(len(grams), bool)
    out = []
    right_all = np.flatnonzero(side == t["high"])
    for i in np.flatnonzero(side == t["low"]).tolist():
        right = right_all if t["low"] != t["high"] else right_all[right_all > i]
        right = right[forest.part[right] != forest.part[i]]
        if not len(right):
            continue
        equal = sig[right] == sig[i]
        good = equal.sum(axis=1) >= matches
        equal &= own[right] & own[i]
        right = right[good & (equal.argmax(axis=1) == coordinate)]
        if not len(right):
            continue
        flags[ids[ends[i] - sizes[i] : ends[i]]] = True
        lengths = sizes[right]
        at = np.repeat(ends[right] - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(flags[ids[at]].astype(np.int64), np.cumsum(lengths) - lengths)
        flags[ids[ends[i] - sizes[i] : ends[i]]] = False
        for j, c in zip(right.tolist(), common.tolist(), strict=True):
            if node[i] == node[j] or forest.part[i] == forest.part[j]:
                continue
            union = sizes[i] + sizes[j] - c
            whole = max(sizes[i], sizes[j]) < SKETCH
            slack = 3 * union  # hash collisions
            if not whole:  # the smallest hashes of the union are a random sample of it, whatever the sizes
                mine, other = (ids[ends[x] - sizes[x] : ends[x]] for x in (i, j))
                sample = np.union1d(mine, other)[:SKETCH]
                union = len(sample)
                c = int(np.isin(sample, np.intersect1d(mine, other)).sum())
                slack = 3 * union + 600 * np.sqrt(union * percent / 100 * (1 - percent / 100))  # six deviations
            if 100 * c + slack < percent * union:
                continue
            out.append((min(node[i], node[j]), max(node[i], node[j])))
            if whole and 100 * c >= percent * union + 300:
                forest.join(i, j)
    return out


def _collide(coordinates: int, matches: int, percent: int):
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        block = {k: t.column(k).to_numpy() for k in ("node", "component", "block", "mask")}
        block |= {k: t.column(k)[0].as_py() for k in ("token", "low", "high")}
        block["signature"] = t.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, coordinates)
        block["sketch"] = [np.frombuffer(b, "<u4") for b in t.column("sketch").to_pylist()]
        found = _pairs_of_block(block, coordinates, matches, percent)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kinds)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                own = tuple(keys[:, first])
                if held and own != key:
                    yield pairs(held)
                    held = []
                key = own
                held.append(batch.slice(first, last - first))
        if held:
            yield pairs(held)

    return run


def collisions(
    lists: DataFrame, described: DataFrame, coordinates: int, matches: int, percent: int, block: int
) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may link, enough of them to tie what is linked together.

    lists: token, node, mask, component; described: node, signature, sketch. A list is cut into blocks of about `block`
    nodes, and each two of its blocks meet in a group of their own, so no task holds more than two blocks. A longer
    list's largest component has blocks of its own, numbered after the others, which don't meet each other.
    """
    sizes = lists.groupBy("token", "component").agg(F.count("*").alias("m"))
    held = sizes.groupBy("token").agg(
        F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("n")
    )
    short = F.col("n") <= block
    cut = held.select(
        "token", F.when(~short, F.col("main")).alias("main"),
        F.when(short, 1).otherwise(F.ceil((F.col("n") - F.col("m")) / block)).cast("int").alias("outer"),
        F.when(short, 0).otherwise(F.ceil(F.col("m") / block)).cast("int").alias("inner"),
    )
    of_main, place = F.coalesce(F.col("component") == F.col("main"), F.lit(False)), F.xxhash64("node")
    own = F.when(of_main, F.col("outer") + F.pmod(place, F.col("inner"))).otherwise(F.pmod(place, F.col("outer"))).cast("int")
    last = F.col("outer") - 1 + F.when(of_main, 0).otherwise(F.col("inner"))
    dealt = (
        lists.join(cut, "token")
        .select("token", "node", "mask", "component", own.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        .join(described, "node")
        .select(
            "token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            "node", "component", "block", "mask", "signature", "sketch",
        )
    )
    met = dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return met.mapInArrow(_collide(coordinates, matches, percent), "a long, b long").distinct()


def open_lists(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """token, node, mask, component, n: the lists whose nodes belong to several components, and their numbers of nodes."""
    placed = lists.drop("df").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = placed.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("n"))
    return placed.join(spans.filter("p <> q").select("token", "n"), "token")


def with_hubs(lists: DataFrame, classes: DataFrame, matches: int, turn: int) -> DataFrame:
    """Pairs (a, b) of a node drawn in each list and the list's nodes of other components, if their signatures may link."""
    drawn = F.min_by(F.struct(F.col("node").alias("a"), F.col("component").alias("c")), F.xxhash64("token", "node", F.lit(turn)))
    hubs = lists.groupBy("token").agg(drawn.alias("hub")).select("token", "hub.*")
    met = lists.join(hubs, "token").filter("component <> c").select(
        F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")
    ).distinct()
    for end in "ab":
        met = met.join(classes.select(F.col("node").alias(end), F.col("signature").alias(f"signature_{end}")), end)
    equal = F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda same: same)
    return met.filter(F.size(equal) >= matches).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = SHINGLE,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by shingle sets of similarity percent / 100.

    docs: doc_id, text; other columns are ignored. Shingles are runs of `shingle` words after lower-casing A-Z; a
    shorter text is one shingle, a null or wordless one is empty and linked with nothing. component_id is the
    smallest doc_id reachable over links. Repeated rows come out as often as they go in; rows of
    one doc_id count as one node of the link graph. A null doc_id links with nothing, keeps a null component_id and is kept.
    An empty table gives no rows. A linked pair is missed only if its signatures agree on fewer than `matches`
    coordinates: at similarity 0.85 with 24 of 48, a chance below 1e-8 for a pair. Confirmed links are exact.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = written(describe(docs, shingle, coordinates), "sets")
    key = ["key_a", "key_b", "n_shingles"]
    grouped = described.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(
        F.min("doc_id").alias("node"), F.min_by("signature", "doc_id").alias("signature")
    )
    classes = written(grouped, "classes")
    lists = written(postings(classes, coordinates, matches), "lists")

    nodes = small_enough(written(lists.select(F.col("node").alias("doc_id")).distinct(), "nodes"))
    firsts = docs.join(nodes, "doc_id").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = written(firsts.select(F.col("doc_id").alias("node"), "text"), "texts")

    hubs = lists.groupBy("token").agg(F.min("node").alias("a"))
    stars = lists.join(hubs, "token").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    tied = written(confirmed(stars, texts, percent, shingle).distinct(), "links")
    parts = written(components(tied), "components")

    star = [F.col("node").alias("a"), F.col("component").alias("b")]  # components as links
    for turn in range(TURNS):
        long = written(open_lists(lists, parts).filter(F.col("n") > block), "long")
        if long.isEmpty():
            break
        more = written(confirmed(with_hubs(long, classes, matches, turn), texts, percent, shingle).distinct(), "links")
        if more.isEmpty():
            break
        parts = written(components(parts.select(*star).unionByName(more)), "components")

    apart = written(open_lists(lists, parts), "open")
    open_texts = texts.join(apart.select("node").distinct(), "node", "left_semi")
    sketches = open_texts.select("node", "text").mapInArrow(_sketch(shingle), "node long, sketch binary")
    described_nodes = written(classes.select("node", "signature").join(sketches, "node"), "sketches")
    pairs = written(collisions(apart, described_nodes, coordinates, matches, percent, block), "pairs")
    further = written(confirmed(pairs, texts, percent, shingle).distinct(), "links")
    final = components(parts.select(*star).unionByName(further))

    reached = classes.join(final, "node", "left").select(
        *key, F.col("node").alias("first"), F.coalesce("component", "node").alias("component")
    )
    found = described.select("doc_id", *key).join(reached, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps; of several rows with one doc_id, one. Rows without doc_id stay."""
    found = near_duplicates(docs, **options).select(F.col("doc_id").alias("_id"), "kept")
    found = written(found.filter("_id IS NOT NULL").groupBy("_id").agg(F.first("kept").alias("kept"), F.count("*").alias("n")), "kept")
    gone = small_enough(written(found.filter("NOT kept").select("_id"), "gone"))
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["_id"], "left_anti")
    if found.filter("kept AND n > 1").isEmpty():
        return left
    named = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(left.filter("doc_id IS NULL"))
