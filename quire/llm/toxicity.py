"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the restored text.

Method. A channel may have replaced letters by look-alikes, repeated them, or put separators or spaces between them.
Each suspicious word spans a lattice: every run of equal characters offers the letters it may stand for, once or
twice. Spaced and very long ones may hold several words, so there the lattice offers word breaks as well. Viterbi
search under a character trigram model finds the likeliest words; the best few are kept. The score is
read from the words as they stand and from the restored ones: a lexicon of words and word beginnings, each with the
smoothed share of toxic texts among the labelled texts that hold it, joined by noisy-or.

Fitting counts all labelled texts that may be learned from, without most near copies; Spark sums the counts by feature.
The fitted model is a table of features (LEXICON at most, else an error) and 28**3 trigram counts; it is broadcast, and
so are the labels of up to a million documents. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.neardup import shingle_sets
from quire.llm.store import small_enough, written
from quire.llm.words import SLAB, Slab, Words, slabs, span_hashes, words
from quire.llm.workers import releasing

LEXICON = 1 << 20
#: Weight of the prior share of toxic texts in a feature's share; about this many texts must support a feature.
PRIOR_TEXTS = 6.0
#: A feature must tell toxic texts from others by this likelihood ratio (chance gives as much to one in a million).
LEAST_RATIO = 24.0
PREFIXES = (4, 5, 6)
PATHS = 4
ENDINGS = range(4, 11)
LONGEST = 64  # runs of characters that are decoded at a time; longer ones in pieces that overlap by half

# Characters and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "%": "x", "*": "aeiou", "#": "h",
}
SEPARATORS = ".-_*~/"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CORE = np.zeros(256, bool)  # what a word may begin and end with
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOOKS = np.zeros(256, bool)
_LOOKS[[ord(c) for c in LOOKALIKES]] = True
_SYMBOLS = np.zeros(256, bool)  # look-alikes that seldom end a word as punctuation
_SYMBOLS[[ord(c) for c in "@$+%*#"]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in SEPARATORS]] = True
_SYMBOL = np.full(256, 27, np.int64)  # 0: word edge, 1-26: letters, 27: anything else
_SYMBOL[97:123] = np.arange(1, 27)


def cores(slab: Slab, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """begin and end of each word without the punctuation around it; equal where nothing is left."""
    core = _CORE[slab.data]
    at = np.arange(len(core))
    after = np.minimum.accumulate(np.where(core, at, len(core))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(core, at, -1))
    begin = np.minimum(after[found.begin], found.end)
    return begin, np.maximum(before[found.end - 1] + 1, begin)


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of the whole words and of their beginnings."""
    whole = np.flatnonzero(end > begin)
    out = [(whole, span_hashes(data, begin[whole], end[whole]))]
    for n in PREFIXES:
        long = np.flatnonzero(end - begin > n)
        out.append((long, span_hashes(data, begin[long], begin[long] + n) + np.uint64(n)))
    return out


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    shares: np.ndarray
    trigrams: np.ndarray  # log probabilities, 28 x 28 x 28
    prior: float

    def __post_init__(self) -> None:
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.cache: dict[tuple[str, bool], list[str]] = {}

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that are features, and their shares."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        near = np.flatnonzero(self.quick[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[near]
        return near[hit], self.shares[place[hit]]

    def restore(self, token: str, several: bool = False) -> list[str]:
        """The likeliest words behind a token, best first; several: the token may hold more than one."""
        if len(token) > 4 * LONGEST:  # not worth keeping
            return decode(token, self.trigrams, several=several)
        if (token, several) not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[token, several] = decode(token, self.trigrams, several=several)
        return self.cache[token, several]


def lattice(token: str) -> list[list[str]]:
    """The letters that each run of equal characters may stand for; separators between single letters stand for none."""
    runs: list[tuple[str, int]] = []
    for c in token.lower():
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    out = []
    for k, (c, n) in enumerate(runs):
        letters = [c] if c.isalpha() else list(LOOKALIKES.get(c, ""))
        options = [*letters, *(x * 2 for x in letters if n > 1)]
        inside = 0 < k < len(runs) - 1
        if c in SEPARATORS and inside:
            options.append("")
        if options:
            out.append(options)
    return out


def decode(token: str, trigrams: np.ndarray, paths: int = PATHS, several: bool = False) -> list[str]:
    """The words of the best paths through the lattice; one of over LONGEST runs is read in overlapping pieces.

    Where there may be several words, the last one may begin anywhere: endings of ENDINGS letters are words, too.
    """
    runs = lattice(token)
    spaced = several
    several |= len(runs) > LONGEST
    out: dict[str, None] = {}
    for first in range(0, max(len(runs) - LONGEST // 2, 1), LONGEST // 2):
        for text in _search(runs[first : first + LONGEST], trigrams, paths, several):
            out.update(dict.fromkeys(text.split()))
            if spaced:
                letters = text.replace(" ", "")
                out.update(dict.fromkeys(letters[-n:] for n in ENDINGS if n < len(letters)))
    return list(out)


def _search(runs: list[list[str]], trigrams: np.ndarray, paths: int, several: bool) -> list[str]:
    """Viterbi search: the state is the last two letters, or the word edge; the best paths over different end states
    come back."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in runs:
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for option in options:
                x, y, s = a, b, score
                for c in option:
                    z = ord(c) - 96 if "a" <= c <= "z" else 27
                    s += trigrams[x, y, z]
                    x, y = y, z
                if (x, y) not in step or step[x, y][0] < s:
                    step[x, y] = (s, text + option)
        if several:
            breaks = [(s + trigrams[x, y, 0], text + " ") for (x, y), (s, text) in step.items() if y]
            if breaks and ((0, 0) not in step or step[0, 0][0] < max(breaks)[0]):
                step[0, 0] = max(breaks)
        best = step
    ended = sorted(((s + (trigrams[a, b, 0] if b else 0.0), t) for (a, b), (s, t) in best.items() if t), reverse=True)
    return [t for _, t in ended[:paths]]


def suspicious(slab: Slab, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges (first, last + 1) that may be disguised words: look-alikes beside letters or one another, letters
    three times in a row or between separators, and runs of at least four single letters; and whether a range may hold
    several words, as spaced and separated letters may."""
    data = slab.data
    n = len(data)
    if not len(found.begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    word = np.zeros(n + 2, np.int64)  # the word of each byte, 0 between words
    word[found.begin + 1] = 1
    word = np.cumsum(word)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, found.begin, 1)
    np.add.at(inside, found.end, -1)
    inside = np.cumsum(inside)[:n] > 0
    letter, looks, digit, apart = _LETTER[data], _LOOKS[data], _DIGIT[data], _APART[data]
    edge = np.zeros(n + 1, bool)
    edge[slab.bounds] = True
    joined = ~edge[1:n]  # a byte and the next are of one document
    odd = np.zeros(n, bool)
    if n > 1:
        odd[:-1] |= looks[:-1] & letter[1:] & joined
        symbol = _SYMBOLS[data]
        odd[1:] |= (digit | symbol)[1:] & letter[:-1] & joined
        odd[1:] |= symbol[1:] & symbol[:-1] & joined
    if n > 2:
        odd[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & joined[1:] & joined[:-1]
    split = np.zeros(n, bool)
    if n > 2:
        split[1:-1] = letter[:-2] & apart[1:-1] & letter[2:] & joined[1:] & joined[:-1]
    of = word[1 : n + 1] - 1
    count = np.bincount(of[odd & inside], minlength=len(found.begin)) > 0
    apart_letters = np.bincount(of[split & inside], minlength=len(found.begin)) >= 3
    count |= apart_letters
    first = np.flatnonzero(count)
    single = (found.end - found.begin == 1) & (letter[found.begin] | looks[found.begin])
    same = np.concatenate([[False], single[1:] & single[:-1] & (found.doc[1:] == found.doc[:-1])])
    begins = np.flatnonzero(single & ~same)
    ends = np.flatnonzero(single & ~np.concatenate([same[1:], [False]])) + 1
    long = ends - begins >= 4
    several = np.concatenate([apart_letters[first], np.ones(int(long.sum()), bool)])
    return np.concatenate([first, begins[long]]), np.concatenate([first + 1, ends[long]]), several


def score_slab(slab: Slab, model: Model) -> np.ndarray:
    low = slab.lowered()
    found = words(low)
    n = slab.last - slab.first
    docs, marks, shares = [], [], []

    def add(data, begin, end, doc, ids):
        for which, hashes in features(data, begin, end):
            at, p = model.look_up(hashes)
            docs.append(doc[which[at]])
            marks.append(ids[which[at]])
            shares.append(p)

    begin, end = cores(low, found)
    add(low.data, begin, end, found.doc, span_hashes(low.data, begin, end))
    first, last, several = suspicious(low, found)
    restored, where = [], []
    data = low.data.tobytes()
    for a, b, many in zip(first.tolist(), last.tolist(), several.tolist(), strict=True):
        token = b"".join(data[found.begin[k] : found.end[k]] for k in range(a, b))
        for text in model.restore(token.decode("utf-8", "replace"), many):
            restored.append(text)
            where.append((int(found.doc[a]), a))
    if restored:
        (other,) = slabs(pa.array(restored), 1 << 40)
        doc, token_of = np.array(where).T
        b, e = other.bounds[:-1], other.bounds[1:]
        add(other.data, b, e, doc, token_of.astype(np.uint64))  # all readings of a token count as one word
    doc, mark, share = np.concatenate(docs), np.concatenate(marks), np.concatenate(shares)
    order = np.lexsort((-share, mark, doc))
    doc, mark, share = doc[order], mark[order], share[order]
    best = np.ones(len(doc), bool)
    best[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    clean = np.bincount(doc[best], np.log1p(-share[best]), minlength=n)
    return 1 - (1 - 0.1 * model.prior) * np.exp(clean)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def known_labels(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """doc_id, label: one row per document that may be learned from, the largest of its labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & usable)
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """text, label of all labelled documents; equal texts count once. Up to a million labels go to the texts, which then
    aren't shuffled before they are joined."""
    known = small_enough(written(known_labels(labels, label, usable), "labels"))
    return _texts_of(docs).join(known, "doc_id").groupBy("text").agg(F.max("label").alias("label"))


def _texts_of(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.filter("text IS NOT NULL")


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """text, label of about `most` labelled documents at most, chosen by a hash of doc_id; equal texts count once."""
    known, texts = known_labels(labels, label, usable), _texts_of(docs)
    n = known.count()
    if n > most:
        chosen = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * most / n)
        known, texts = known.filter(chosen), texts.filter(chosen)
    return texts.join(known, "doc_id").groupBy("text").agg(F.max("label").alias("label"))


@releasing
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, toxic, clean): kind 0 texts, 1 features, 2 letter trigrams."""
    kinds = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def rows(kind, key, toxic, clean):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(toxic), pa.array(clean)],
            schema=kinds,
        )

    for batch in batches:
        label = batch.column(1).to_numpy()
        for slab in slabs(batch.column(0), SLAB):
            low = slab.lowered()
            found = words(low)
            toxic = label[slab.first : slab.last] > 0
            yield rows(0, np.zeros(1, np.int64), np.array([toxic.sum()]), np.array([(~toxic).sum()]))
            begin, end = cores(low, found)
            own = features(low.data, begin, end)
            key = np.concatenate([h for _, h in own])
            doc = np.concatenate([found.doc[w] for w, _ in own])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            if len(key):
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                t = np.add.reduceat(toxic[doc].astype(np.int64), starts)
                yield rows(1, key[starts], t, np.diff(np.append(starts, len(key))) - t)
            full = end > begin
            b, e = begin[full], end[full]
            length = e - b + 1  # the letters and the end of the word
            at = np.repeat(b - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            place = at - np.repeat(b, length)
            z = np.where(place == np.repeat(length - 1, length), 0, _SYMBOL[low.data[np.minimum(at, len(low.data) - 1)]])
            y = np.where(place >= 1, _SYMBOL[low.data[at - 1]], 0)
            x = np.where(place >= 2, _SYMBOL[low.data[at - 2]], 0)
            tri, n = np.unique(x * 784 + y * 28 + z, return_counts=True)
            yield rows(2, tri, n, np.zeros(len(tri), np.int64))


@releasing
def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label and the smallest shingle hash of the text, which near copies mostly share; 0 without words."""
    for batch in batches:
        least = []
        for slab in slabs(batch.column(0), SLAB):
            grams, at = shingle_sets(slab)
            least.append(np.where(np.diff(at) > 0, np.append(grams, 0)[at[:-1]].view(np.int64), 0))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.concatenate(least) if least else np.zeros(0, np.int64))], names=["text", "label", "least"]
        )


def apart(known: DataFrame) -> DataFrame:
    """text, label of few of the near copies among them: a group of copies that share their words by origin must not
    count those words as often as it has members. One text is kept per smallest shingle hash and label; of a thousand
    copies of similarity 0.9 that leaves about four."""
    least = known.select("text", "label").mapInArrow(_grouped, "text string, label int, least long")
    return least.groupBy("least", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """The lexicon and the character model from all labelled texts; `usable`: which doc_ids may be learned from."""
    counted = apart(labelled(docs, labels, "toxic", usable)).select("text", "label").mapInArrow(
        _count, "kind int, key long, toxic long, clean long"
    )
    sums = counted.groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = written(sums, "toxicity-counts")
    total = sums.filter("kind = 0").first()
    toxic, clean = (total["toxic"], total["clean"]) if total else (0, 0)
    prior = (toxic + 0.5) / (toxic + clean + 1.0)
    share = (F.col("toxic") + PRIOR_TEXTS * prior) / (F.col("toxic") + F.col("clean") + PRIOR_TEXTS)
    n = F.col("toxic") + F.col("clean")
    ratio = 2 * (
        F.when(F.col("toxic") > 0, F.col("toxic") * F.log(F.col("toxic") / (n * prior))).otherwise(0)
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - prior)))).otherwise(0)
    )
    chosen = (
        sums.filter("kind = 1").filter(ratio >= LEAST_RATIO).select("key", "toxic", share.alias("share")).filter("share >= 0.5")
        .limit(LEXICON + 1).collect()
    )
    if len(chosen) > LEXICON:
        raise ValueError(f"more than {LEXICON} features: raise LEXICON, which bounds what is broadcast")
    chosen.sort(key=lambda r: r["key"] & (2**64 - 1))
    counts = np.zeros(28**3)
    for r in sums.filter("kind = 2").select("key", "toxic").collect():  # at most 28 ** 3 rows
        counts[r["key"]] = r["toxic"]
    counts = counts.reshape(28, 28, 28)
    pair = counts.sum(axis=0)
    back = (pair + 0.5) / (pair + 0.5).sum(axis=1, keepdims=True)
    trigrams = np.log((counts + 2.0 * back[None]) / (counts.sum(axis=2, keepdims=True) + 2.0))
    return Model(
        np.array([r["key"] for r in chosen], np.int64).view(np.uint64),
        np.array([min(r["share"], 1 - 1e-6) for r in chosen]), trigrams, prior,
    )


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with one more column (double, 0 to 1), which must not be one of docs; null texts count as empty."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    kept = (model.keys, model.shares, model.trigrams, model.prior)
    shared = docs.sparkSession.sparkContext.broadcast(kept)  # bounded: LEXICON features and 28 ** 3 trigrams

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [score_slab(slab, own) for slab in slabs(batch.column("text"), SLAB)]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Labels are learned only from rows whose
    crc32(doc_id as text) modulo `parts` is not 0; doc_id decides that split and nothing else. Null labels and labels
    without a text teach nothing; several labels of one document count as its largest. A null or empty text scores a
    tenth of the share of toxic texts, as does one without any feature; without labels no word is a feature. Repeated
    rows score alike, a null doc_id is not held out, an empty table gives no rows. Tokens and spaced runs of any
    length are decoded.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id"), parts, 0))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(source, model)
    return out.select(
        "doc_id", held_out(F.col("doc_id"), parts, 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
