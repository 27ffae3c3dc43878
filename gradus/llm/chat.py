"""Chat formatting of messages with typed content parts.

A visitor turns the parts of a message (text, image, audio, document) into one text
in which every part that is not text is a placeholder, and records the attachment
behind each placeholder with the number of tokens it will take.  Turns are framed by
control strings; a control string inside a text gets a backslash after its first
character (one more if it has some already), so that reading back is exact.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings: opening and closing per role, and the placeholders."""

    frames: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    #: Any other role is written out between the first two.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    placeholders: dict[str, str] = field(
        default_factory=lambda: {
            "image": "<image>",
            "audio": "<audio>",
            "document": "<document>",
        }
    )
    trained: tuple[str, ...] = ("assistant",)
    image_patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 512

    def __post_init__(self) -> None:
        controls = self.controls
        if len(set(controls)) < len(controls) or any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("control strings must differ, be longer than 1 and hold no backslash")
        for a in controls:
            for b in controls:
                if any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))) or (
                    a != b and b in a
                ):
                    raise ValueError(f"control strings overlap: {a} {b}")

    @property
    def controls(self) -> list[str]:
        frames = [c for pair in self.frames.values() for c in pair]
        return [*frames, *self.other, *self.placeholders.values()]

    def pattern(self, slashes: str) -> re.Pattern:
        choices = "|".join(f"{re.escape(c[0])}{slashes}{re.escape(c[1:])}" for c in self.controls)
        return re.compile(f"(?:{choices})")

    def escape(self, text: str) -> str:
        return self.pattern(r"\\*").sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.pattern(r"\\+").sub(lambda m: m[0][0] + m[0][2:], text)


class PartVisitor:
    """Flattens the parts of one message; attachments are numbered in their order."""

    def __init__(self, template: ChatTemplate) -> None:
        self.template = template
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:
            raise ValueError(f"unknown part {kind!r}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(self.template.escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        patch = self.template.image_patch
        across = math.ceil((part.get("width") or 0) / patch)
        self._attach("image", part, max(1, across * math.ceil((part.get("height") or 0) / patch)))

    def visit_audio(self, part: dict) -> None:
        tokens = (part.get("seconds") or 0.0) * self.template.audio_tokens_per_second
        self._attach("audio", part, max(1, math.ceil(tokens)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, (part.get("pages") or 0) * self.template.tokens_per_page))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        mark = self.template.placeholders[kind]
        self.attachments.append(
            {"ordinal": len(self.attachments), "kind": kind, "uri": part.get("uri"), "tokens": tokens}
        )
        self.pieces.append(mark)

    def text(self) -> str:
        # Two text parts may form a control string together; escape it as one text.
        out, run = [], ""
        for piece in self.pieces:
            if piece in self.template.placeholders.values():
                out += [run, piece]
                run = ""
            elif run:
                run = self.template.escape(self.template.unescape(run) + self.template.unescape(piece))
            else:
                run = piece
        return "".join([*out, run])


PARTS = (
    "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
)
TURNS = (
    "conv_id long, turn long, role string, formatted string, loss_from int, loss_to int, "
    "attachments array<struct<ordinal:int,kind:string,uri:string,tokens:int>>, media_tokens long"
)
_ATTACHMENT = pa.struct(
    [("ordinal", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())]
)
_TURN_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
        ("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
        ("attachments", pa.list_(_ATTACHMENT)), ("media_tokens", pa.int64()),
    ]
)


def format_turn(role: str | None, text: str | None, parts: list | None, template: ChatTemplate) -> dict:
    """One framed turn, the places of its trained text, and its attachments."""
    visitor = PartVisitor(template)
    for part in [{"kind": "text", "text": text}] if parts is None else parts:
        visitor.visit(part or {})
    inner = visitor.text()
    role = role or ""
    if role in template.frames:
        opening, closing = template.frames[role]
    else:
        before, after, closing = template.other
        opening = before + template.escape(role) + after
    trained = role in template.trained
    return {
        "role": role,
        "formatted": opening + inner + closing,
        "loss_from": len(opening) if trained else None,
        "loss_to": len(opening) + len(inner) if trained else None,
        "attachments": visitor.attachments,
        "media_tokens": sum(a["tokens"] for a in visitor.attachments),
    }


def format_conversations(
    messages: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
) -> DataFrame:
    """One framed turn per message; a conversation is its turns one after another.

    ``parts_col`` holds typed parts (see ``PARTS``); where it is null or not given
    the text is the only part.  A null text is empty, a null role is the empty one.
    ``loss_from`` and ``loss_to`` are character places in ``formatted`` of the text
    to train on, null for the roles that are not trained.  Rows with a null
    conversation form one conversation.  Each message is formatted by itself, so no
    conversation is ever gathered here.
    """
    parts = F.lit(None) if parts_col is None else F.col(parts_col)
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        parts.cast(PARTS).alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [
                {"conv_id": c, "turn": t} | format_turn(r, x, p, template)
                for c, t, r, x, p in zip(*(batch.column(i).to_pylist() for i in range(5)))
            ]
            yield pa.RecordBatch.from_pylist(turns, _TURN_SCHEMA)

    return rows.mapInArrow(run, TURNS)


class TurnReader:
    """Reads framed turns from a growing text."""

    def __init__(self, template: ChatTemplate) -> None:
        self.template = template
        self.closing = {o: (role, c) for role, (o, c) in template.frames.items()}
        self.controls = template.pattern("")
        self.marks = re.compile("|".join(re.escape(p) for p in template.placeholders.values()))
        self.rest = ""

    def plain(self, inner: str) -> str:
        """The text of a turn without placeholders, control strings as they were."""
        return "".join(self.template.unescape(piece) for piece in self.marks.split(inner))

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that is now complete."""
        self.rest += text
        before, after, last = self.template.other
        while start := self.controls.match(self.rest):
            if start[0] == before:
                end = self.rest.find(after, start.end())
                if end < 0:
                    return
                role, closing, at = self.template.unescape(self.rest[start.end() : end]), last, end + len(after)
            elif start[0] in self.closing:
                (role, closing), at = self.closing[start[0]], start.end()
            else:
                raise ValueError(f"a turn can't start with {start[0]!r}")
            end = self.rest.find(closing, at)
            if end < 0:
                return
            inner = self.rest[at:end]
            self.rest = self.rest[end + len(closing) :]
            yield role, self.plain(inner)


READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def read_back(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of every conversation, read from the framed turns and the loss places.

    Turns are taken in the order (turn, role, formatted), nulls first.  A conversation
    is read as a stream, one turn in memory at a time, since its digests run over all
    its turns in order.
    """
    ordered = (
        turns.select("conv_id", "turn", "role", "formatted", "loss_from", "loss_to")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted")
    )
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
        + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Digest | None = None
        for batch in batches:
            done = []
            columns = ("conv_id", "formatted", "loss_from", "loss_to")
            for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in columns)):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(conv, template)
                state.add(text, a, b)
            yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.row()], schema)

    return ordered.mapInArrow(run, READ_BACK)


class _Digest:
    def __init__(self, conv: int | None, template: ChatTemplate) -> None:
        self.conv, self.reader = conv, TurnReader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, text: str, loss_from: int | None, loss_to: int | None) -> None:
        self.chars += len(text)
        for role, plain in self.reader.feed(text):
            self.n += 1
            self.turns.update(f"{role}\n{plain}\n".encode("utf-8", "surrogatepass"))
        if loss_from is not None:
            learnt = self.reader.plain(text[loss_from:loss_to])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))

    def row(self) -> dict:
        if self.reader.rest:
            raise ValueError(f"conversation {self.conv} ends inside a turn")
        return {
            "conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }
