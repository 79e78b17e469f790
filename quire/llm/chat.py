"""Chat formatting: typed content parts to one marked text with a loss mask, and back.

Method. A turn's content is text or a JSON list of typed parts. A visitor walks the parts, nested ones included, and
writes text as it is and image, audio and document parts as placeholders in order; it records each attachment's
reference, place and the number of tokens it expands to. Turns are then marked:

    <|im_start|>role NEWLINE content<|im_end|> NEWLINE

Control strings begin with "<|". Inside texts and roles every "<" followed by backslashes and a bar gets one backslash
more, so no text can hold a control string, and reading takes one away again. The loss mask is a list of spans that
cover exactly the texts of assistant turns.

Turns are dealt by ranges of (conv_id, turn), so a conversation of any length is spread over tasks. A task writes pieces
of whole turns of about PIECE characters. Conversations that lie whole in one piece (nearly all) are read back where they
are; the others, at most two a task and those longer than a piece, are brought together by conv_id and read piece by piece.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
LEARNED = "assistant"
KINDS = ("image", "audio", "document")
START, END = "<|im_start|>", "<|im_end|>"
CLOSE = "<|/document|>"

#: Tokens of attachments: a patch of 28 x 28 pixels, 25 a second, 512 a page; 256 where the extent isn't known.
PATCH, PER_SECOND, PER_PAGE, UNKNOWN = 28, 25, 512, 256

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_MARK = re.compile(r"<\|(?:/?document|image|audio)\|>")

ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())])
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
PIECES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()),
    ("formatted", pa.string()), ("loss", pa.list_(SPAN)), ("attachments", pa.list_(ATTACHMENT)), ("expanded_tokens", pa.int64()),
])
_OUTPUT = (
    "conv_id long, part int, piece long, whole boolean, n_turns long, formatted string,"
    " loss array<struct<start:long,length:long>>,"
    " attachments array<struct<kind:string,ref:string,start:long,tokens:long>>, expanded_tokens long"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape, and on one line: backslashes doubled, line ends written as backslash n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _number(part: dict, key: str) -> float | None:
    value = part.get(key)
    fits = isinstance(value, (int, float)) and not isinstance(value, bool) and 0 < value < 1e12
    return value if fits else None


def _sound(text: str) -> str:
    """Text that UTF-8 can hold: JSON may spell halves of surrogate pairs, which become question marks."""
    return text.encode("utf-8", "replace").decode()


class Flatten:
    """Visitor over typed parts: collects the turn's text runs and placeholders in order, and the attachments."""

    def __init__(self, count: Callable[[str], int] | None = None):
        self.count = count
        self.out: list[str] = []
        self.length = 0
        self.run: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, parts: Any) -> None:
        """Walks parts of any depth in order, without recursion."""
        ahead = [parts]
        while ahead:
            part = ahead.pop()
            if isinstance(part, list):
                ahead += reversed(part)
            elif isinstance(part, str):
                self.visit_text({"text": part})
            elif isinstance(part, _Close):
                self.put(CLOSE)
            elif part is not None:
                kind = part.get("type") if isinstance(part, dict) else None
                method = getattr(self, f"visit_{kind}", None) if kind == "text" or kind in KINDS else None
                inner = method(part) if method else self.visit_other(part)
                if inner is not None:
                    ahead += [_Close(), inner]

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.run.append("" if text is None else text if isinstance(text, str) else json.dumps(text, ensure_ascii=False))

    def visit_image(self, part: dict) -> None:
        width, height = _number(part, "width"), _number(part, "height")
        self.attach("image", part, math.ceil(width / PATCH) * math.ceil(height / PATCH) if width and height else UNKNOWN)

    def visit_audio(self, part: dict) -> None:
        seconds = _number(part, "seconds")
        self.attach("audio", part, math.ceil(seconds * PER_SECOND) if seconds else UNKNOWN)

    def visit_document(self, part: dict) -> list:
        """A document's own parts, if any, follow its placeholder and end with a closing one."""
        pages, inner = _number(part, "pages"), part.get("parts")
        inner = inner if isinstance(inner, list) else []
        self.attach("document", part, math.ceil(pages) * PER_PAGE if pages else 0 if inner else UNKNOWN)
        return inner

    def visit_other(self, part: Any) -> None:
        """Parts of unknown types are kept as their JSON text."""
        self.run.append(json.dumps(part, ensure_ascii=False))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.close_run()
        ref = part.get("ref", part.get("url"))
        ref = ref if ref is None else _sound(ref if isinstance(ref, str) else json.dumps(ref, ensure_ascii=False))
        self.attachments.append({"kind": kind, "ref": ref, "start": self.length, "tokens": tokens})
        self.tokens += tokens
        self.put(f"<|{kind}|>")

    def put(self, mark: str) -> None:
        self.close_run()
        self.out.append(mark)
        self.length += len(mark)

    def close_run(self) -> None:
        """Adjacent texts are one run and are escaped together."""
        if self.run:
            text = _sound("".join(self.run))
            self.run = []
            self.tokens += self.count(text) if self.count else 0
            text = escape(text)
            self.out.append(text)
            self.length += len(text)

    def content(self) -> str:
        self.close_run()
        return "".join(self.out)


class _Close:
    """Marks where a document's own parts end."""


def typed(parts: str | None, text: str | None) -> Any:
    """The parts of a row: its JSON list, or its text where that is null or isn't a list."""
    if parts is not None:
        try:
            found = json.loads(parts)
        except (ValueError, RecursionError):
            return [parts]
        return found if isinstance(found, list) else [found]
    return ["" if text is None else text]


class _Piece:
    """Whole turns of one conversation, up to about `limit` characters."""

    def __init__(self, conv_id: int | None, number: int):
        self.conv_id, self.number = conv_id, number
        self.text: list[str] = []
        self.length = self.turns = self.tokens = 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def add(self, role: str | None, flat: Flatten) -> None:
        role = role or ""
        content = flat.content()
        head = f"{START}{escape_role(role)}\n"
        begin = self.length + len(head)
        if role == LEARNED:
            self.loss.append({"start": begin, "length": len(content)})
        self.attachments += [a | {"start": a["start"] + begin} for a in flat.attachments]
        turn = f"{head}{content}{END}\n"
        self.text.append(turn)
        self.length += len(turn)
        self.turns += 1
        self.tokens += flat.tokens


def _format(count: Callable[[str], int] | None, limit: int):
    def batch_of(held: list[tuple[_Piece, bool]], part: int) -> pa.RecordBatch:
        rows = [{
            "conv_id": p.conv_id, "part": part, "piece": p.number, "whole": whole, "n_turns": p.turns,
            "formatted": "".join(p.text), "loss": p.loss, "attachments": p.attachments, "expanded_tokens": p.tokens,
        } for p, whole in held]
        return pa.RecordBatch.from_pylist(rows, schema=PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, first, ready, size = None, True, [], 0
        for batch in batches:
            for conv_id, role, parts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = Flatten(count)
                flat.visit(typed(parts, text))
                if piece is not None and (piece.conv_id != conv_id or piece.length >= limit):
                    same = piece.conv_id == conv_id
                    ready.append((piece, not same and not first and piece.number == 0))
                    size += piece.length
                    first &= same  # a task's first conversation may have begun in the task before
                    piece = _Piece(conv_id, piece.number + 1 if same else 0)
                    if size >= limit:
                        yield batch_of(ready, part)
                        ready, size = [], 0
                elif piece is None:
                    piece = _Piece(conv_id, 0)
                piece.add(role, flat)
        if piece is not None:
            ready.append((piece, False))
        if ready:
            yield batch_of(ready, part)

    return run


def format_conversations(
    rows: DataFrame, parts: str | None = None, count: Callable[[str], int] | None = None, limit: int = PIECE
) -> DataFrame:
    """Formatted conversations as pieces: conv_id, part, piece, whole, n_turns, formatted, loss, attachments, expanded_tokens.

    rows: conv_id, turn, role, text; other columns are ignored. `parts` names a column with a JSON list of typed parts
    ({"type": "text" | "image" | "audio" | "document", ...}), which counts where it isn't null; JSON of another kind is a
    single part, and what isn't JSON is text. A conversation's pieces in order of (part, piece), joined, are its formatted
    text; one with `whole` is all of it. loss and attachment positions count code points from the start of the piece.
    expanded_tokens adds up the tokens of attachments and, where `count` is given, of text runs.
    Turns are ordered by turn (null first), then role, then text, so ties have one order; repeated rows are turns of
    their own. Null roles and texts are empty ones; rows without conv_id are one conversation. An empty table gives no rows.
    """
    other = F.col(parts).cast("string") if parts else F.lit(None).cast("string")
    source = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), other.alias("parts"), F.col("text").cast("string").alias("text"),
    )
    dealt = source.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text", "parts")
    return dealt.select("conv_id", "role", "parts", "text").mapInArrow(_format(count, limit), _OUTPUT)


def read_turns(formatted: str) -> list[tuple[str, list[str]]]:
    """(role, runs) per turn of a formatted text: runs are unescaped texts and, between them, placeholders."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        at = m.end()
        runs, last = [], 0
        for mark in _MARK.finditer(m[2]):
            runs += [unescape(m[2][last : mark.start()]), mark[0]]
            last = mark.end()
        out.append((unescape_role(m[1]), [*runs, unescape(m[2][last:])]))
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return out


class _Digest:
    """What reading a conversation's pieces in order yields."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.tokens = self.attached = 0

    def add(self, formatted: str, loss: list[dict], attachments: list, tokens: int) -> None:
        for role, runs in read_turns(formatted):
            self.turns.update(f"{role}\n{''.join(runs[::2])}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(_MARK.sub("", formatted[span["start"] : span["start"] + span["length"]]))
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)
        self.tokens += tokens
        self.attached += len(attachments)

    def row(self, conv_id: int | None) -> dict:
        return {
            "conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars, "n_attachments": self.attached,
            "expanded_tokens": self.tokens,
        }


_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("expanded_tokens", pa.int64()),
])
_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,"
    " n_attachments long, expanded_tokens long"
)


def _read(apart: bool):
    """Digests of conversations whose pieces come one after the other; with `apart`, each piece is a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, own = None, None
        for batch in batches:
            done = []
            for conv_id, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is not None and (apart or conv_id != own):
                    done.append(digest.row(own))
                    digest = None
                digest, own = digest or _Digest(), conv_id
                digest.add(*piece)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_READ)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([digest.row(own)], schema=_READ)

    return run


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted pieces alone.

    conv_id, n_turns, turns_sha256 (of role, line end, text, line end per turn; placeholders count as nothing), loss_chars
    and loss_sha256 (of the text under the loss mask, unescaped), formatted_chars, n_attachments, expanded_tokens.
    pieces: a written table of format_conversations(), which is read twice. Digests run over a conversation in order, so
    the pieces of a split one stream through one task, a piece at a time.
    """
    columns = ["conv_id", "formatted", "loss", "attachments", "expanded_tokens"]
    whole = pieces.filter("whole").select(*columns).mapInArrow(_read(True), _DIGEST)
    split = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(split.select(*columns).mapInArrow(_read(False), _DIGEST))
