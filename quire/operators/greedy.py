"""Greedy selection in order: a row stays unless a row kept before it clashes with it.

Rows stream through one pass in order of their key; what a pass holds is an index of the word sets kept so far for one
key, never the key's rows. The same pass serves keys of every size.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEW = 48  # sets that are compared one by one
LIMBS = 4  # 64-bit limbs of a signature
DROPPED = 40  # set keys a lookup of smaller sets may try
ROWS = 256  # that stand as Python objects at a time


@lru_cache(maxsize=1 << 16)
def least_common(a: int, b: int, t: float) -> int:
    """The fewest words that sets of these sizes must share for a similarity of t."""
    o = max(0, math.floor(t / (1 + t) * (a + b)) - 1)
    while o / max(a + b - o, 1) < t:
        o += 1
    return o


class Shelf:
    """Kept sets of one size: a bit signature each, and for every word the sets that hold it."""

    def __init__(self, size: int):
        self.size = size
        self.sets: list[frozenset] = []
        self.signatures = np.zeros((64, LIMBS), np.uint64)
        self.by_word: dict[int, array] = {}

    def add(self, words: frozenset, signature: np.ndarray) -> None:
        n = len(self.sets)
        if n == len(self.signatures):
            self.signatures = np.concatenate([self.signatures, np.zeros_like(self.signatures)])
        self.signatures[n] = signature
        self.sets.append(words)
        for w in words:
            self.by_word.setdefault(w, array("l")).append(n)

    def has_similar(self, words: frozenset, signature: np.ndarray, common: int) -> bool:
        """Whether a set here shares `common` words. Such a set holds one of any size - common + 1 of the words; those
        with the shortest lists are asked. Sets whose signatures differ in too many bits are passed over unread."""
        lists = sorted((self.by_word[w] for w in words if w in self.by_word), key=len)
        spare = len(words) - common + 1 - (len(words) - len(lists))  # words that no set here holds count as asked
        if spare <= 0:
            return False
        far = len(words) + self.size - 2 * common
        for found in lists[:spare]:
            rows = np.frombuffer(found, np.int64)
            for first in range(0, len(rows), 4096):
                block = rows[first : first + 4096]
                off = np.bitwise_count(self.signatures[block] ^ signature).sum(axis=1)
                for k in block[off <= far].tolist():
                    if len(words & self.sets[k]) >= common:
                        return True
        return False


class WordSets:
    """Sets of words that can be asked for one of similarity >= t.

    Equal sets are found by hash, and so are smaller ones that lack a few words of the one asked for. Other sets stand on
    a shelf by their size; a similar one must share a number of words that follows from both sizes.
    """

    def __init__(self, t: float):
        self.t = t
        self.number: dict[str, int] = {}
        self.whole: set[frozenset] = set()
        self.few: list[frozenset] = []
        self.shelves: dict[int, Shelf] = {}

    def _numbered(self, words: frozenset, new: bool) -> frozenset:
        """Words as numbers; unknown ones get a number of their own, kept only if `new`."""
        number, out, fresh = self.number, [], len(self.number)
        for w in words:
            k = number.get(w)
            if k is None:
                k, fresh = fresh, fresh + 1
                if new:
                    number[w] = k
            out.append(k)
        return frozenset(out)

    @staticmethod
    def _signature(words: frozenset) -> np.ndarray:
        bits = 0
        for w in words:
            bits |= 1 << (w % (64 * LIMBS))
        return np.frombuffer(bits.to_bytes(8 * LIMBS, "little"), np.uint64)

    def add(self, words: frozenset) -> None:
        own = self._numbered(words, True)
        if own in self.whole:
            return
        self.whole.add(own)
        if len(self.whole) <= FEW:
            self.few.append(own)
            return
        for s in self.few:
            self._shelve(s)
        self.few = []
        self._shelve(own)

    def _shelve(self, own: frozenset) -> None:
        self.shelves.setdefault(len(own), Shelf(len(own))).add(own, self._signature(own))

    def has_similar(self, words: frozenset) -> bool:
        own, n, t = self._numbered(words, False), len(words), self.t
        if own in self.whole:
            return True
        for other in self.few:
            both = len(own & other)
            if both / (n + len(other) - both) >= t:
                return True
        if not self.shelves:
            return False
        signature = None
        for size, shelf in self.shelves.items():
            common = least_common(n, size, t)
            if common > min(n, size) or common == n == size:
                continue  # too unlike in size, or only an equal set would do
            if common == size < n and math.comb(n, size) <= DROPPED:  # a set here must lie within this one
                if any(frozenset(s) in self.whole for s in combinations(own, size)):
                    return True
                continue
            if signature is None:
                signature = self._signature(own)
            if shelf.has_similar(own, signature, common):
                return True
        return False


class PageTitles:
    """Keeps a title unless one kept before, on a page at most `near` away, is similar; priority 0 is always kept."""

    columns = ("priority", "page_num", "words")

    def __init__(self, near: int, t: float):
        self.near, self.t = near, t
        self.pages: dict[int, WordSets] = {}

    def keep(self, priority, page, words) -> bool:
        if page is None or words is None:
            return True
        own = frozenset(words)
        if priority != 0:
            for p in range(page - self.near, page + self.near + 1):
                if p in self.pages and self.pages[p].has_similar(own):
                    return False
        self.pages.setdefault(page, WordSets(self.t)).add(own)
        return True


class DocumentTitles:
    """Keeps a title unless one kept before is similar; a kept title counts in its cleaned form."""

    columns = ("words", "clean_words")

    def __init__(self, t: float):
        self.kept = WordSets(t)

    def keep(self, words, clean) -> bool:
        if words is None:
            return True
        if self.kept.has_similar(frozenset(words)):
            return False
        self.kept.add(frozenset(clean))
        return True


def select(rows: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Callable[[], PageTitles | DocumentTitles]) -> DataFrame:
    """The rows that a fresh rule per key keeps, asked in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                asked = zip(
                    zip(*(batch.column(c).to_pylist() for c in keys), strict=True),
                    *(batch.column(c).to_pylist() for c in rule().columns), strict=True,
                )
                flags = []
                for own, *values in asked:
                    if state is None or own != last:
                        state, last = rule(), own
                    flags.append(state.keep(*values))
                yield batch.filter(pa.array(flags, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, rows.schema)
