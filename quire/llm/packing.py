"""Hierarchical multi-length packing: tokenised documents, tiers of context sizes, sequences without padding.

Method. Every document is tokenised and routed to the smallest tier that holds it; what is longer than the largest
window is cut into whole windows and a rest, and the rest is routed like a document. Each tier is packed by itself:
documents follow one another in open windows of the tier's size, and what does not fit continues in the next window.
When the input of a task ends, the open window of the longest tier is filled from the open windows of shorter tiers,
and the last rest is cut into windows whose sizes are powers of two, so no window has padding. Step groups are numbered
over the whole result: the sequences of every tier, in order, are dealt to all groups in equal shares of tokens, so each
group holds about the same number of tokens and the same mix of tiers.

Work is split by the partitions of the input and needs no shuffle: a sequence holds documents of one partition.
A task holds one batch of texts, one open window per tier and a bounded cache of word ids. Its pieces are written with
the tokens of their tier that came before in the task; tokens per task and tier, a few numbers a task, give the rest.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.store import small_enough, written
from quire.llm.words import SLAB, Slab, slabs, word_hashes, words
from quire.llm.workers import releasing

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 64 * 2048
CACHE_WORDS = 300_000
#: Sequences per task that fit the id space of one task (2 ** SEQUENCE_BITS).
SEQUENCE_BITS = 36

_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the tokenizer's own pattern
_WORD_END = b"\xff"
_LEAD_C2, _LESS, _BAR = 0xC2, 0x3C, 0x7C
#: Bytes that send a document to the tokenizer itself: control characters and everything from U+0180 on.
_UNUSUAL = np.zeros(256, bool)
_UNUSUAL[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, 0xC0, 0xC1, *range(0xC6, 0x100)]] = True
#: Second bytes after 0xC2 that do so too: controls, no-break space, soft hyphen.
_UNUSUAL_C2 = np.zeros(256, bool)
_UNUSUAL_C2[[*range(0x80, 0xA1), 0xAD]] = True


class WordEncoder:
    """Ids of the word-level byte-pair tokenizer for whole columns of text.

    Its pattern never reaches over white space and its normaliser only lower-cases what is plain Latin text, so the
    ids of a text are those of its words. Distinct words of a slab are looked up once in a bounded cache; new ones go
    to the rank merger of `tiktoken`, loaded with the same vocabulary (the byte 0xFF, which UTF-8 never has, stands
    for the word end). Documents with other characters, or with `<|`, go to `tokenizers` as a whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        letters = _byte_letters()
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            ends = token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + (_WORD_END if ends else b"")] = i
        if max(model["vocab"].values()) >= 1 << 16:
            raise ValueError(f"{path} has ids beyond 16 bits")
        self.whole = Tokenizer.from_file(path)
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.cache_words = cache_words
        self.pattern = regex.compile(_PIECE)
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.ids = array("H")
        self.begins = array("q", [0])

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text as unsigned 16-bit numbers (the vocabulary has fewer than 65,536)."""
        for slab in slabs(column, 2 * SLAB):
            yield from self._slab(slab)

    def _slab(self, slab: Slab) -> Iterator[np.ndarray]:
        n = slab.last - slab.first
        slow = self._unusual(slab)
        low = slab.lowered()
        found = words(low)
        hashes, first, which = np.unique(word_hashes(low, found), return_index=True, return_inverse=True)
        if len(self.place) > self.cache_words:
            self.forget()
        keys = hashes.tolist()
        place = self.place
        data = low.data.tobytes()
        for k, at in zip(keys, first.tolist(), strict=True):
            if k not in place:
                place[k] = len(self.begins) - 1
                self._append(data[found.begin[at] : found.end[at]])
        index = np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))
        begins = np.asarray(self.begins)
        lengths = begins[index + 1] - begins[index]
        size = lengths[which]
        ends = np.cumsum(size)
        out = np.asarray(self.ids)[np.repeat(begins[index][which] - (ends - size), size) + np.arange(size.sum())]
        bounds = np.concatenate([[0], ends])[found.at]
        for d in range(n):
            if slow[d]:
                text = slab.data[slab.bounds[d] : slab.bounds[d + 1]].tobytes().decode("utf-8", "replace")
                yield np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
            else:
                yield out[bounds[d] : bounds[d + 1]]

    @staticmethod
    def _unusual(slab: Slab) -> np.ndarray:
        data = slab.data
        odd = _UNUSUAL[data]
        if len(data) > 1:
            odd[:-1] |= (data[:-1] == _LEAD_C2) & _UNUSUAL_C2[data[1:]]
            odd[:-1] |= (data[:-1] == _LESS) & (data[1:] == _BAR)
        at = np.flatnonzero(odd)
        return np.searchsorted(at, slab.bounds[1:]) > np.searchsorted(at, slab.bounds[:-1])

    def _append(self, word: bytes) -> None:
        """Ids of a word between white space: letters, letters and one more character, or the general pattern."""
        head = word[:-1]
        if word.isascii() and word.isalpha():
            self.ids.frombytes(self._piece(word))
        elif head.isascii() and head.isalpha() and word[-1] != 39 and word[-1] < 128:
            self.ids.frombytes(self._piece(head))
            self.ids.frombytes(self._piece(word[-1:]))
        else:
            for piece in self.pattern.findall(word.decode("utf-8", "replace").lower()):
                self.ids.frombytes(self._piece(piece.encode()))
        self.begins.append(len(self.ids))

    def _piece(self, piece: bytes) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = array("H", self.merge._encode_single_piece(piece + _WORD_END)).tobytes()
        return ids


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Packer:
    """Packs the documents of one task; pieces come out when their window is complete."""

    def __init__(self, task: int, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.base = task << SEQUENCE_BITS
        self.next = 0
        self.open: dict[int, list] = {t: [] for t in self.tiers}
        self.filled = dict.fromkeys(self.tiers, 0)
        self.closed: dict[int, int] = {}  # tokens by tier
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        """A document; ids end with its end id."""
        total, at, largest = len(ids), 0, self.tiers[-1]
        while total - at >= largest:
            self._close([(doc_id, at, ids[at : at + largest], total)], largest)
            at += largest
        if at < total:
            tier = next(t for t in self.tiers if t >= total - at)
            self._place(tier, doc_id, at, ids[at:], total)

    def _place(self, tier: int, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            room = tier - self.filled[tier]
            self.open[tier].append((doc_id, start, ids[:room], total))
            self.filled[tier] += len(ids[:room])
            start, ids = start + len(ids[:room]), ids[room:]
            if self.filled[tier] == tier:
                self._close(self.open[tier], tier)
                self.open[tier], self.filled[tier] = [], 0

    def _close(self, pieces: list, tier: int) -> None:
        at, sequence = 0, self.base + self.next
        before = self.closed.get(tier, 0)
        for doc_id, start, ids, total in pieces:
            wide = ids.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(wide), total, sequence, at, tier, before, wide))
            at += len(ids)
        self.next += 1
        self.closed[tier] = before + at

    def finish(self) -> None:
        """Open windows: the longest is filled from the shorter ones, the rest is cut at powers of two."""
        largest = self.tiers[-1]
        rest = [p for t in reversed(self.tiers) for p in self.open[t]]
        self.open, self.filled = {t: [] for t in self.tiers}, dict.fromkeys(self.tiers, 0)
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(largest, 1 << (left.bit_length() - 1))
            pieces, need = [], size
            while need:
                doc_id, start, ids, total = rest.pop(0)
                pieces.append((doc_id, start, ids[:need], total))
                if len(ids) > need:
                    rest.insert(0, (doc_id, start + need, ids[need:], total))
                need -= len(pieces[-1][2])
            self._close(pieces, size)
            left -= size

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier int, before long"
)
_ARROW = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
    ("before", pa.int64()), ("ids", pa.binary()),
]


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: where its ids start in the document, its sequence and its place there.

    docs: doc_id, text; other columns are ignored. A null text is an empty one, and an empty one is its end id alone.
    A null doc_id stays null. Repeated rows are packed as often as they occur. tokenizer: path of the vocabulary
    file, by default the public word-level one of the executors' own installation. tiers: powers of two; the largest
    is the window that other sizes are padded to, so none is. An empty table gives no rows. The strings of special
    tokens in a text are what the tokenizer makes of them. with_ids adds the ids (unsigned 32-bit, little-endian).
    step_group: the whole result's sequences in groups of about step_tokens tokens, each with its share of every tier; a
    group is off by one sequence of each size at most. A vocabulary with ids beyond 16 bits raises an error.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    fields = [f for f in _ARROW if with_ids or f[0] != "ids"]
    kinds = pa.schema(fields)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        end = np.asarray([end_id], np.uint16)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                packer.add(doc_id, np.concatenate([ids, end]))
                if len(packer.rows) >= 500:
                    yield _rows(packer.take(), kinds)
        encoder.forget()  # the worker goes on to other tasks
        packer.finish()
        if packer.rows:
            yield _rows(packer.take(), kinds)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _grouped(written(source.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else "")), "pieces"), step_tokens)


def _grouped(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """Pieces with their step group instead of `before`."""
    task = F.shiftright("sequence_id", SEQUENCE_BITS)
    counts = pieces.groupBy(task.alias("_task"), F.col("tier").alias("_tier")).agg(F.sum("length").alias("n"))
    tier = W.partitionBy("_tier")
    counts = counts.select(
        "_task", "_tier", F.coalesce(F.sum("n").over(tier.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.sum("n").over(tier).alias("_tier_tokens"),
    )
    total = pieces.agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, -(-total // step_tokens))
    counts = small_enough(written(counts, "packed"))
    here = (task == counts["_task"]) & (pieces["tier"] == counts["_tier"])
    place = F.expr(f"cast(cast(_ahead + before as decimal(19,0)) * {groups} div _tier_tokens as bigint)")
    order = [c for c in pieces.columns if c not in ("before", "ids")] + ["step_group"] + ["ids"] * ("ids" in pieces.columns)
    return pieces.join(counts, here).withColumn("step_group", place).select(*order)


def _rows(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))[: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
