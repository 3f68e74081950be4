"""Chat formatting of typed content parts.

A message's content is an ordered list of parts: text, image, audio or document. A
visitor flattens it: text is escaped, the other kinds become placeholders, in place, and
each leaves an attachment reference and the number of tokens it will expand to.
Placeholders number on through a conversation. Turns are framed by control strings;
``Reader`` takes the output apart again, chunk by chunk, into parts.

Escaping: a backslash is written twice, ``<|`` as ``<\\|``; no escaped text holds ``<|``,
so control strings in a text can neither open nor close a turn nor pass for a placeholder
(text parts side by side, empty ones between them included, are joined before that),
and reading is exact: ``format_messages`` and ``format_table`` take typed parts,
``read_messages`` and ``read_table`` give them back.

Conversations are sorted by turn within their partition and streamed, one turn in memory
at a time: a conversation of any length takes bounded memory (its digests are sequential
by definition, so one task must see it).

Defined cases: a null text or role is empty; a null turn comes first; rows of equal turn
go by role, then text; repeated rows are separate turns; rows of null conv_id form one
conversation of null id; null parts are none, a null part is left out, a part of null kind
is text, one of unknown kind raises ValueError; of two text parts side by side the reader
gives one; null numbers are 0 and null references empty; no rows: no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Pixels of an image's side, milliseconds of audio, and tokens of a document page, for one token.
PATCH, FRAME_MS, PAGE_TOKENS = 28, 40, 768


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor):
        return visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int
    height: int

    def accept(self, visitor):
        return visitor.image(self)


@dataclass(frozen=True)
class Audio:
    ref: str
    milliseconds: int

    def accept(self, visitor):
        return visitor.audio(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int

    def accept(self, visitor):
        return visitor.document(self)


def part(row: dict):
    """A part from a struct<type, text, ref, width, height, milliseconds, pages>."""
    kind, number = row.get("type"), lambda k: int(row.get(k) or 0)
    if kind in ("text", None):
        return Text(row.get("text") or "")
    if kind == "image":
        return Image(row.get("ref") or "", number("width"), number("height"))
    if kind == "audio":
        return Audio(row.get("ref") or "", number("milliseconds"))
    if kind == "document":
        return Document(row.get("ref") or "", number("pages"))
    raise ValueError(f"unknown part type {kind!r}")


@dataclass
class Flattener:
    """Visits parts in order; placeholders number on through a conversation."""

    attachments: list[dict] = field(default_factory=list)

    def _placeholder(self, kind: str, ref: str, tokens: int) -> str:
        self.attachments.append({"index": len(self.attachments), "kind": kind, "ref": ref, "tokens": tokens})
        return f"<|{kind}_{len(self.attachments) - 1}|>"

    def text(self, p: Text) -> str:
        return escape(p.text)

    def image(self, p: Image) -> str:
        return self._placeholder("image", p.ref, math.ceil(p.width / PATCH) * math.ceil(p.height / PATCH))

    def audio(self, p: Audio) -> str:
        return self._placeholder("audio", p.ref, math.ceil(p.milliseconds / FRAME_MS))

    def document(self, p: Document) -> str:
        return self._placeholder("document", p.ref, p.pages * PAGE_TOKENS)

    def content(self, parts) -> str:
        # neighbouring texts are one before they are escaped: a control string must not
        # come together from the pieces
        out = []
        for is_text, run in groupby(parts, lambda p: isinstance(p, Text)):
            out += [self.text(Text("".join(p.text for p in run)))] if is_text else [p.accept(self) for p in run]
        return "".join(out)

    def message(self, parts: list[dict | None] | None) -> str:
        return self.content([part(p) for p in parts or [] if p is not None])


def frame(role: str, content: str) -> str:
    """One turn; a line feed in the role is written as backslash n, for it ends the header."""
    head = escape(role).replace("\n", "\\n")
    return f"{START}{head}\n{content}{END}\n"


_PLACEHOLDER = re.compile(r"<\|(image|audio|document)_([0-9]+)\|>")


def read_parts(body: str) -> list[tuple[str, str | int]]:
    """A turn's content as ("text", the text) and (kind, index of its attachment)."""
    out, last = [], 0
    for m in _PLACEHOLDER.finditer(body):
        if m.start() > last:
            out.append(("text", unescape(body[last : m.start()])))
        out.append((m[1], int(m[2])))
        last = m.end()
    if last < len(body):
        out.append(("text", unescape(body[last:])))
    return out


class Reader:
    """Takes formatted output, in pieces cut anywhere; yields (role, parts, mask) by turn,
    where mask says whether the turn's text is under the loss mask."""

    def __init__(self, loss_roles: tuple[str, ...] = ("assistant",)):
        self.rest, self.loss_roles = "", loss_roles

    def feed_parts(self, piece: str) -> Iterator[tuple[str, list, bool]]:
        self.rest += piece
        while (end := self.rest.find(END + "\n")) >= 0:
            turn, self.rest = self.rest[: end + len(END) + 1], self.rest[end + len(END) + 1 :]
            if not turn.startswith(START):
                raise ValueError("a turn must open with its control string")
            head, _, body = turn[len(START) : -len(END) - 1].partition("\n")
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
            yield role, read_parts(body), role in self.loss_roles

    def feed(self, piece: str) -> Iterator[tuple[str, str, bool]]:
        """As feed_parts, with the turn's text alone."""
        for role, parts, masked in self.feed_parts(piece):
            yield role, "".join(x for kind, x in parts if kind == "text"), masked

    def close(self) -> None:
        if self.rest:
            raise ValueError("the output ends within a turn")


def format_messages(messages: list[dict]) -> tuple[str, list[dict]]:
    """The formatted conversation and its attachments; a message is a role and parts."""
    flat = Flattener()
    return "".join(frame(m.get("role") or "", flat.message(m.get("parts"))) for m in messages), flat.attachments


def read_messages(formatted: str, attachments: list[dict]) -> list[dict]:
    """The messages again: text parts, and for each placeholder its attachment."""
    reader = Reader()
    by = {a["index"]: a for a in attachments}
    out = [{"role": role, "parts": [{"type": k, "text": x} if k == "text" else {"type": k, **{n: by[x][n] for n in ("ref", "tokens")}} for k, x in parts]} for role, parts, _ in reader.feed_parts(formatted)]
    reader.close()
    return out


def _sorted_turns(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


PART = "struct<type:string,text:string,ref:string,width:long,height:long,milliseconds:long,pages:long>"
ATTACHMENT = pa.list_(pa.struct([("index", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
READ_PART = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_table(messages: DataFrame) -> DataFrame:
    """conv_id, position, formatted, attachments, n_attachments, expanded_tokens by turn, from
    conv_id, turn, role, parts (an array of PART; missing fields are null). The formatted
    turns of a conversation, joined by position, are its formatted output."""
    fields = {f.name for f in messages.schema["parts"].dataType.elementType.fields}
    wanted = dict(x.split(":") for x in PART[7:-1].split(","))
    parts = F.transform("parts", lambda p: F.when(p.isNotNull(), F.struct(*[(p[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in wanted.items()])))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))

    def run(batches):
        conv, k, flat = None, 0, None
        for b in batches:
            position, out, found = [], [], []
            for c, role, listed in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "parts")), strict=True):
                if flat is None or c != conv:
                    conv, k, flat = c, 0, Flattener()
                before = len(flat.attachments)
                out.append(frame(role, flat.message(listed)))
                found.append(flat.attachments[before:])
                position.append(k)
                k += 1
            yield pa.record_batch([b.column("conv_id"), pa.array(position, pa.int64()), pa.array(out, pa.string()), pa.array(found, ATTACHMENT)], names=["conv_id", "position", "formatted", "attachments"])

    made = ordered.mapInArrow(run, "conv_id long, position long, formatted string, attachments array<struct<index:long,kind:string,ref:string,tokens:long>>")
    return made.withColumn("n_attachments", F.size("attachments").cast("long")).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_table(formatted: DataFrame) -> DataFrame:
    """conv_id, position, role, parts from format_table's output: a turn's text parts, and
    for each placeholder its attachment's kind, reference and tokens."""

    def run(batches):
        for b in batches:
            roles, parts = [], []
            for text, found in zip(b.column("formatted").to_pylist(), b.column("attachments").to_pylist(), strict=True):
                (m,) = read_messages(text, found)
                roles.append(m["role"])
                parts.append(m["parts"])
            yield pa.record_batch([b.column("conv_id"), b.column("position"), pa.array(roles, pa.string()), pa.array(parts, READ_PART)], names=["conv_id", "position", "role", "parts"])

    return formatted.select("conv_id", "position", "formatted", "attachments").mapInArrow(run, "conv_id long, position long, role string, parts array<struct<type:string,text:string,ref:string,tokens:long>>")


def as_messages(turns: DataFrame) -> DataFrame:
    """Turns of plain text as messages of one text part."""
    return turns.select("conv_id", "turn", "role", F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"))).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position, formatted: each turn of plain text as it stands in the output."""
    return format_table(as_messages(turns)).select("conv_id", "position", "formatted")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self):
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text, masked in self.reader.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if masked:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv):
        self.reader.close()
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Formats every conversation and reads the digests back from the output."""
    ordered = _sorted_turns(turns)

    def run(batches):
        names = DIGESTS.replace(" long", "").replace(" string", "").split(", ")
        types = [pa.string() if "sha" in n else pa.int64() for n in names]
        conv, at = None, None

        def batch(rows):
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            done = []
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if at is None or c != conv:
                    if at is not None:
                        done.append(at.row(conv))
                    conv, at = c, _Digest()
                at.add(frame(role, Flattener().content([Text(text)])))
            if done:
                yield batch(done)
        if at is not None:
            yield batch([at.row(conv)])

    return ordered.mapInArrow(run, DIGESTS)
