"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn, in order: text is escaped, and images, audio and documents become
placeholders, with a record of the attachment and the tokens that it expands to. A turn is

    <|turn|>ROLE<|says|>CONTENT<|end|>

Control strings, ours and other templates', never occur in escaped text: a backslash goes after their first character, and
backslashes are doubled. Text parts that follow one another are escaped together, so no control string comes about where
two of them meet. Turns are formatted row by row, so a conversation of any length needs no group; a conversation
is its segments in order.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Strings that steer chat templates; they are escaped inside texts.
CONTROL = ["<|turn|>", "<|says|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
TURN, SAYS, END = CONTROL[:3]
#: Roles whose text is under the loss mask.
LOSS_ROLES = frozenset({"assistant"})

PARTS = "array<struct<type: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>>"
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.S)
_MARK = re.compile("|".join(map(re.escape, CONTROL[3:6])))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn. Unknown types and nulls count as text; sizes that are missing count as one unit."""

    #: Tokens of an attachment: for each square tile, second, and page.
    TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 336, 144, 25, 600

    def __init__(self):
        self.out: list[str] = []
        self.run: list[str] = []  # text parts since the last attachment
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def content(self) -> str:
        """What has been visited, formatted."""
        if self.run:
            self.out.append(escape("".join(self.run)))
            self.run = []
        return "".join(self.out)

    def visit_text(self, part):
        self.run.append(part.get("text") or "")

    def visit_image(self, part):
        tiles = math.ceil((part.get("width") or 1) / self.TILE) * math.ceil((part.get("height") or 1) / self.TILE)
        self.attach("image", part, tiles * self.TILE_TOKENS)

    def visit_audio(self, part):
        self.attach("audio", part, math.ceil((part.get("seconds") or 1) * self.SECOND_TOKENS))

    def visit_document(self, part):
        self.attach("document", part, (part.get("pages") or 1) * self.PAGE_TOKENS)

    def attach(self, kind: str, part: dict, tokens: int):
        self.content()
        self.attachments.append({"position": len(self.attachments), "type": kind, "uri": part.get("uri"), "tokens": tokens})
        self.out.append(f"<|{kind}|>")


_FORMATTED = "segment string, loss_start int, loss_length int, attachments array<struct<position: int, type: string, uri: string, tokens: int>>, expanded_tokens long"
_ATTACHMENTS = pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, parts) -> (conv_id, turn, segment, loss_start, loss_length, attachments, expanded_tokens), row by row.

    The loss mask of a turn is the range of its segment (in code points) that holds the content of a trained role. A
    null role or null parts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for role, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                visitor = Flatten()
                for part in parts or []:
                    visitor.visit(part or {})
                head, content = f"{TURN}{escape(role or '')}{SAYS}", visitor.content()
                trained = role in LOSS_ROLES
                rows.append((f"{head}{content}{END}", len(head) if trained else 0, len(content) if trained else 0, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), _ATTACHMENTS, pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["conv_id", "turn", "segment", "loss_start", "loss_length", "attachments", "expanded_tokens"])

    kinds = dict(turns.dtypes)
    return turns.select("conv_id", "turn", "role", F.col("parts").cast(PARTS)).mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {_FORMATTED}")


def text_parts(text: Column) -> Column:
    """A plain text as its only part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def parse(formatted: str) -> list[tuple[str, str]]:
    """A formatted conversation, or a part of one that holds whole turns -> its (role, text) in order; placeholders are left out."""
    return [(unescape(role), unescape(_MARK.sub("", content))) for role, content in _SEGMENT.findall(formatted)]


def parse_parts(content: str) -> list[tuple[str, str | None]]:
    """The content of a turn -> its parts in order: ("text", text), runs of text as one, and (kind, None) for attachments."""
    out, at = [], 0
    for m in [*_MARK.finditer(content), None]:
        text = content[at : m.start() if m else len(content)]
        out += [("text", unescape(text))] if text else []
        if m:
            out.append((m[0][2:-2], None))
            at = m.end()
    return out


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of format_turns, one row for each conversation.

    Turns are dealt by conversation and sorted; a task streams them and keeps two running hashes, so memory doesn't
    grow with a conversation (SHA-256 has to see a conversation in one order in one place). Turns that tie in their
    number are taken in the order of their segments. A null conv_id is a conversation of its own.
    """
    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"
    names = ["conv_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done, arrow = None, None, [], None

        def row():
            return at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]

        for b in slices(batches):
            arrow = arrow or pa.schema([b.schema.field(0)] + [(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names[1:]])
            for conv, segment, start, length, tokens in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if at != (conv,):
                    if at:
                        done.append(row())
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(_MARK.sub("", segment[start : start + length]))
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
                state[5] += tokens
            if len(done) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=arrow)
                done = []
        if at:
            done.append(row())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=arrow)

    kind = dict(formatted.dtypes)["conv_id"]
    dealt = formatted.select("conv_id", "turn", "segment", "loss_start", "loss_length", "expanded_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return dealt.select("conv_id", "segment", "loss_start", "loss_length", "expanded_tokens").mapInArrow(run, f"conv_id {kind}, {schema}")
