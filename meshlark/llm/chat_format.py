"""Chat formatting with typed content parts.

A turn's content is text, or a list of typed parts (text, image, audio, document).
A visitor walks the parts in order and flattens them to one string: text is escaped,
every other part leaves a placeholder such as ``<|image:0|>`` whose number counts the
attachments of the turn, and is recorded as an attachment reference with the number
of tokens that it expands to.

Template, for each turn::

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Escaping is reversible: in a text, ``<`` followed by any number of backslashes and
``|`` gets one more backslash, so no control string can arise from a text; a role also
has its backslashes and line ends escaped.  ``parse`` undoes both and returns the
turns with the loss mask's share: the content of turns by ``assistant``.

Turns are formatted where they lie, row by row, before any shuffle.  A conversation
is then the concatenation of its segments by turn; ``digests`` streams over the
sorted segments of a conversation with running hashes, so that a conversation of any
length needs memory for one Arrow batch only.

Defined cases: a null text is empty and a null role is the empty role; rows with the
same turn are ordered by role, then text; repeated rows are turns of their own; a null
conv_id is a conversation of its own; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm._worker import frugal

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
KINDS = ("text", "image", "audio", "document")
#: Tokens that one unit of a part expands to: an image tile, a second of sound, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<(\\*)\\\|")
_HOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE = {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\\\|\\n", lambda m: _ROLE[m[0]], unescape(role))


@dataclass
class Flattened:
    """What the visitor has made of a turn's parts so far."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') if part.get('kind') in KINDS else 'text'}")(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def _attach(self, part: dict, kind: str) -> None:
        tokens = TOKENS_PER_UNIT[kind] * max(1, part.get("units") or 1)
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.expanded_tokens += tokens

    def visit_image(self, part: dict) -> None:
        self._attach(part, "image")

    def visit_audio(self, part: dict) -> None:
        self._attach(part, "audio")

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document")


def flatten(parts: list[dict]) -> Flattened:
    out = Flattened()
    for part in parts:
        out.visit(part)
    return out


def segment(role: str | None, parts: list[dict]) -> tuple[str, int, int, Flattened]:
    """The formatted turn, its loss span inside it (start, end; empty if none) and the flattened content."""
    flat = flatten(parts)
    head, content = f"{START}{escape_role(role or '')}\n", "".join(flat.pieces)
    start = len(head)
    end = start + len(content) if role == LOSS_ROLE else start
    return f"{head}{content}{END}\n", start, end, flat


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and contents of a formatted string; placeholders stay as they are."""
    at = 0
    for m in _SEGMENT.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a formatted turn at {at}")
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2])
    if at != len(formatted):
        raise ValueError(f"not a formatted turn at {at}")


_SCHEMA = "formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,tokens:long>>, expanded_tokens long"


def format_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted segment, loss span, attachments, expanded tokens."""
    content = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("kind"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))
    own = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), content.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        for batch in batches:
            conv, turn, role, parts = (batch.column(i) for i in range(4))
            made = [segment(r, p or []) for r, p in zip(role.to_pylist(), parts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [conv, turn, role, pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64()), pa.array([x[3].attachments for x in made], kinds), pa.array([x[3].expanded_tokens for x in made], pa.int64())],
                names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    types = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(frugal(run), f"conv_id {types['conv_id']}, turn {types['turn']}, role string, {_SCHEMA}")


class _Running:
    """Hashes over one conversation's segments, read back one after another."""

    def __init__(self, conv) -> None:
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_start: int, loss_end: int) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[loss_start:loss_end])
        self.loss += len(masked)
        self.masked.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted segments: turns, loss text and length."""
    # a turn's number, then role, then its formatted text (the role is the same there, so the text decides)
    dealt = segments.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    conv_type = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Running | None = None
        kind = None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            conv, formatted, start, end = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
            for i in range(len(conv)):
                if now is None or now.conv != conv[i]:
                    if now is not None:
                        done.append(now.row())
                    now = _Running(conv[i])
                now.add(formatted[i], start[i], end[i])
            if done:
                yield packed(done)
        if now is not None:
            yield packed([now.row()])

    return dealt.mapInArrow(frugal(run), f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
