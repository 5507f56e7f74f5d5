"""Chat formatting of typed content parts, with attachments, a loss mask and a way back.

A visitor walks over a turn's parts: text is escaped and kept, images, audio and documents
become numbered placeholders, with their references and the number of tokens that each will be
expanded to on record. A turn is written as ``<s>[INST]role[/INST]text</s>``; the text
of assistant turns is under the loss mask.

Control strings inside texts and roles are escaped: one backslash goes after their first sign
(and one more to those that stand there already), so that reading takes one away again and
every text comes back as it was.

Turns are formatted row by row. What belongs to a whole conversation (its order, digests,
lengths) is made by streaming over turns sorted within hash partitions, so even a conversation
with a third of all turns needs no more memory than a batch; its digest is sequential by
nature and so made in one task.

Defined cases: a null text, role or list of parts is empty; an unknown part type is an error;
turns go by number (null first), then role, then text; repeated rows are turns of their own;
a null conversation id is one conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings: their first sign, the backslashes after it, and the rest.
CONTROL = r"([<])(\\*)((?:/?s|(?:image|audio|document):[0-9]+)>)|(\[)(\\*)(/?INST\])"
_CONTROL = re.compile(CONTROL)


def escape(text: str) -> str:
    """One backslash more in every control string."""
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}" if m[1] else f"{m[4]}\\{m[5]}{m[6]}", text)


def unescape(text: str) -> str:
    """One backslash less in every escaped control string; placeholders have none and stay."""
    return _CONTROL.sub(lambda m: f"{m[1]}{m[2][1:]}{m[3]}" if m[1] else f"{m[4]}{m[5][1:]}{m[6]}", text)


def unescaped(formatted: Column) -> Column:
    """The same for a column of texts without placeholders."""
    plain = F.regexp_replace(formatted, r"<\\(\\*(?:/?s|(?:image|audio|document):[0-9]+)>)", "<$1")
    return F.regexp_replace(plain, r"\[\\(\\*/?INST\])", "[$1")


@dataclass(frozen=True)
class Part:
    """A piece of a turn: ``kind`` is text, image, audio or document."""

    kind: str
    text: str | None = None
    reference: str | None = None
    width: int = 0
    height: int = 0
    seconds: float = 0.0
    pages: int = 0


@dataclass(frozen=True)
class Attachment:
    """What stands behind placeholder ``number``, and the tokens it will be expanded to."""

    number: int
    kind: str
    reference: str
    tokens: int


@dataclass(frozen=True)
class Expansion:
    """How many tokens attachments take: image patches, audio frames a second, tokens a page."""

    patch: int = 28
    frames_per_second: float = 12.5
    tokens_per_page: int = 512


@dataclass
class PartVisitor:
    """Flattens parts in order; ``first`` is the number of the next placeholder."""

    expansion: Expansion = Expansion()
    first: int = 0
    pieces: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, part: Part) -> None:
        handler = getattr(self, f"visit_{part.kind}", None)
        if handler is None:
            raise ValueError(f"unknown content part: {part.kind}")
        handler(part)

    def visit_text(self, part: Part) -> None:
        self.pieces.append(escape(part.text or ""))

    def visit_image(self, part: Part) -> None:
        step = self.expansion.patch
        self._place(part, max(1, math.ceil(part.width / step) * math.ceil(part.height / step)))

    def visit_audio(self, part: Part) -> None:
        self._place(part, max(1, math.ceil(part.seconds * self.expansion.frames_per_second)))

    def visit_document(self, part: Part) -> None:
        self._place(part, max(1, part.pages * self.expansion.tokens_per_page))

    def _place(self, part: Part, tokens: int) -> None:
        number = self.first + len(self.attachments)
        self.pieces.append(f"<{part.kind}:{number}>")
        self.attachments.append(Attachment(number, part.kind, part.reference or "", tokens))


@dataclass(frozen=True)
class Turn:
    """A formatted turn; ``loss`` is the half-open span under the loss mask, empty if none."""

    formatted: str
    loss: tuple[int, int]
    attachments: list[Attachment]


def format_turn(role: str, parts: list[Part], expansion: Expansion = Expansion(), first: int = 0) -> Turn:
    visitor = PartVisitor(expansion, first)
    for kind, run in itertools.groupby(parts, key=lambda p: p.kind):
        if kind == "text":  # neighbours are escaped together, lest their seam makes a control string
            visitor.visit(Part("text", "".join(p.text or "" for p in run)))
        else:
            for part in run:
                visitor.visit(part)
    head, body = f"<s>[INST]{escape(role)}[/INST]", "".join(visitor.pieces)
    start = len(head)
    end = start + len(body) if role == "assistant" else start
    return Turn(f"{head}{body}</s>", (start, end), visitor.attachments)


TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a formatted text; placeholders stay in the text."""
    end = 0
    for m in TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError(f"not a formatted turn at {end}")
        end = m.end()
        yield unescape(m[1]), unescape(m[2])
    if end != len(formatted):
        raise ValueError(f"not a formatted turn at {end}")


PART_TYPE = (
    "array<struct<kind:string,text:string,reference:string,width:int,height:int,seconds:double,pages:int>>"
)
ATTACHMENT_TYPE = "array<struct<number:int,kind:string,reference:string,tokens:long>>"


def text_parts(text: str = "text"):
    """Column: a list with one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("reference"),
            F.lit(0).alias("width"),
            F.lit(0).alias("height"),
            F.lit(0.0).alias("seconds"),
            F.lit(0).alias("pages"),
        )
    )


def format_turns(turns: DataFrame, expansion: Expansion = Expansion()) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end, attachments) for every row.

    ``turns``: (conv_id, turn, role, parts). Placeholders are numbered within a turn.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                values = [Part(**{k: v for k, v in p.items() if v is not None}) for p in parts or [] if p]
                made.append(format_turn(role or "", values, expansion))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([m.formatted for m in made], pa.string()),
                    pa.array([m.loss[0] for m in made], pa.int64()),
                    pa.array([m.loss[1] for m in made], pa.int64()),
                    pa.array(
                        [[vars(a) for a in m.attachments] for m in made],
                        pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("reference", pa.string()), ("tokens", pa.int64())])),
                    ),
                ],
                names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"],
            )

    schema = (
        "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, "
        f"attachments {ATTACHMENT_TYPE}"
    )
    kinds = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(PART_TYPE))
    return kinds.mapInArrow(batches, schema)


class _Reader:
    """Running digests of one conversation, fed with its formatted turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_attachments = self.attachment_tokens = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, start: int, end: int, attachments: list[dict]) -> None:
        for role, text in read_turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())
        self.formatted_chars += len(formatted)
        self.n_attachments += len(attachments or [])
        self.attachment_tokens += sum(a["tokens"] for a in attachments or [])

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.formatted_chars,
            "n_attachments": self.n_attachments,
            "attachment_tokens": self.attachment_tokens,
        }


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_attachments long, attachment_tokens long"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read from its formatted turns in order."""
    names = [c.split(" ")[0] for c in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST_SCHEMA.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Reader | None = None
        done: list[dict] = []
        for batch in source:
            for conv_id, text, start, end, attachments in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Reader(conv_id)
                current.feed(text, start, end, attachments)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in zip(names, kinds)], names=names)
                done = []
        if current is not None:
            row = current.row()
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds)], names=names)

    # turns that tie go by their texts as they were before escaping
    length = F.char_length("formatted") - F.col("loss_start") - F.lit(len("</s>"))
    body = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), length.cast("int"))
    order = [F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")), unescaped(body)]
    ordered = formatted.repartition("conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end", "attachments").mapInArrow(batches, DIGEST_SCHEMA)


#: The digest of ``conversations`` and conversation -1 for DuckDB.
SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, len(regexp_extract_all(role, $re$<\\*(/?s|(image|audio|document):[0-9]+)>|\[\\*/?INST\]$re$))
          + len(regexp_extract_all(text, $re$<\\*(/?s|(image|audio|document):[0-9]+)>|\[\\*/?INST\]$re$)) as escapes
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(text) + escapes + length('<s>[INST][/INST]</s>')) as bigint) as formatted_chars,
       cast(0 as bigint) as n_attachments, cast(0 as bigint) as attachment_tokens
from sized group by conv_id
"""
