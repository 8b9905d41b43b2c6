"""Chat formatting with a grammar round trip.

Grammar (a deterministic parser reads it left to right):

    conversation := turn*
    turn := "[INST]" text "[/INST]"            user
          | "<<SYS>>" text "<</SYS>>"          system
          | "[ROLE " name "]" text "[/ROLE]"   any other role, name percent-coded
          | text "</s>"                        assistant

Every turn is rendered raw, parsed back and compared with its source.  Where
they differ the text holds a control string (or something that looks like an
escaped one); it is escaped and compared again until they are identical.
Escaping puts one more backslash after the first character of each control
string that already has any number of them, so undoing it is exact for every
text.  A rendered turn ends at its own closing mark, so turns can be rendered
and checked anywhere and in any order; only reading a conversation back, whose
digests run over its turns in order, follows the order of its rows, as a stream
over sorted rows that holds one turn at a time.

Defined results: null texts and roles count as empty, null turns come first and
null conversation ids form one conversation; rows with the same turn follow by
role, then text, repeated rows are turns of their own; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the template: role, opening and closing mark.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
OTHER_OPEN, OTHER_CLOSE = "[ROLE ", "[/ROLE]"

_TAILS = r"(INST\]|/INST\]|<SYS>>|</SYS>>|ROLE |/ROLE\]|s>|/s>)"
_NEAR = re.compile(r"([\[<])(\\*)" + _TAILS)
_ESCAPED = re.compile(r"([\[<])\\(\\*)" + _TAILS)
_CONTROL = re.compile(r"[\[<]" + _TAILS)


def escape(text: str) -> str:
    return _NEAR.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"{OTHER_OPEN}{quote(role, safe='')}]", OTHER_CLOSE)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError where it breaks the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        role = "assistant"
        for name, (start, _) in MARKS.items():
            if start and formatted.startswith(start, at):
                role, at = name, at + len(start)
        close = MARKS[role][1]
        if role == "assistant" and formatted.startswith(OTHER_OPEN, at):
            end = formatted.find("]", at)
            if end < 0:
                raise ValueError("role without end")
            role, at, close = unquote(formatted[at + len(OTHER_OPEN):end]), end + 1, OTHER_CLOSE
        found = _CONTROL.search(formatted, at)
        if not found or found[0] != close:
            raise ValueError(f"no {close} after position {at}")
        turns.append((role, unescape(formatted[at:found.start()])))
        at = found.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int, bool]:
    """One formatted turn, the place of its text in it, and whether it was escaped."""
    start, close = marks(role)
    body, escaped = text, False
    while True:
        formatted = f"{start}{body}{close}"
        try:
            same = parse(formatted) == [(role, text)]
        except ValueError:
            same = False
        if same:
            return formatted, len(start), len(start) + len(body), escaped
        body, escaped = escape(body), True


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_end, escaped): each
    turn formatted and checked; the loss span is empty but for assistants."""
    source = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(cast(role as string), '') role", "coalesce(cast(text as string), '') text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(r, t) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            learn = [r == "assistant" for r in batch["role"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([d[0] for d in done], pa.string()),
                 pa.array([d[1] if x else 0 for d, x in zip(done, learn, strict=True)], pa.int64()),
                 pa.array([d[2] if x else 0 for d, x in zip(done, learn, strict=True)], pa.int64()),
                 pa.array([d[3] for d in done], pa.bool_())],
                names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end", "escaped"])

    return source.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long, escaped boolean")


class _Reader:
    """What is read back from the formatted turns of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def feed(self, formatted: str, start: int, end: int) -> None:
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        learned = unescape(formatted[start:end])
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.chars += len(formatted)

    def row(self) -> list:
        return [self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    read from the formatted turns of each conversation in order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        done: list[list] = []
        for batch in batches:
            for conv, piece, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append([now, *reader.row()])
                    now, reader = conv, _Reader()
                reader.feed(piece, start, end)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in done], types)
                done = []
        if reader is not None:
            done.append([now, *reader.row()])
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in done], types)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)


#: A conversation of control strings only, formatted with the others.
CONFLICT = "</s>[INST] ok [/INST]"


def with_conflict(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = spark.sql(f"select -1L conv_id, 0L turn, 'user' role, '{CONFLICT}' text union all select -1L, 1L, 'assistant', '{CONFLICT}'")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)
