"""Chat formatting into budgeted windows: turn-aligned spans, a retained system turn, limited history, one loss per target."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, tidy, to_batch
from .tokens import WordTokenizer

START, END = "<|im_start|>", "<|im_end|>\n"
#: A window of the output: turns first_turn..last_turn carry loss where the assistant speaks; the first
#: context_turns turns in the text repeat the system turn and earlier history and carry none.
SCHEMA = "conv_id long, window long, first_turn long, last_turn long, context_turns long, n_tokens long, text string, loss_starts array<long>, loss_ends array<long>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Make control strings harmless: a backslash is doubled and ``<|`` gets one inside."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as the template marks it, and where its text starts and ends within. A role's line ends become ``\\0``."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + '0')}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int
    at: int


class _Windows:
    """Cuts the turns of one conversation, as they arrive, into windows; holds no more than a window and its history."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: _Turn | None = None
        self.past: list[_Turn] = []
        self.open: list[_Turn] = []
        self.context: list[_Turn] = []
        self.n, self.sum, self.number = 0, 0, 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = _Turn(role, text, tokens, self.n)
        self.n += 1
        if self.open and self.sum + tokens > self.budget:
            yield self.close(tokens)
        self.open.append(turn)
        self.sum += tokens
        if turn.at == 0 and role == "system":
            self.system = turn

    def close(self, coming: int = 0) -> tuple:
        """The open window as a row; the next one starts with the system turn and what history fits beside ``coming`` tokens."""
        parts, at, starts, ends = [], 0, [], []
        for k, turn in enumerate(self.context + self.open):
            text, a, b = render(turn.role, turn.text)
            if k >= len(self.context) and turn.role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            parts.append(text)
            at += len(text)
        row = (self.conv_id, self.number, self.open[0].at, self.open[-1].at, len(self.context), self.sum, "".join(parts), starts, ends)
        self.number += 1
        self.past = (self.past + self.open)[-self.history :] if self.history else []
        keep = [self.system] if self.system and self.system.tokens + coming <= self.budget else []
        sums = np.cumsum([t.tokens for t in reversed(self.past)] or [0])  # of the nearest turns
        room = self.budget - coming - sum(t.tokens for t in keep)
        n = int(np.searchsorted(sums, room, "right")) if self.past else 0
        tail = self.past[len(self.past) - n :] if n else []
        self.context = keep + [t for t in tail if t is not self.system]
        self.open, self.sum = [], sum(t.tokens for t in self.context)
        return row


def format_windows(conversations: DataFrame, tokenizer: str, budget: int = 2048, history: int = 4) -> DataFrame:
    """Windows (:data:`SCHEMA`) of at most ``budget`` tokens for each conversation; columns conv_id, turn, role, text are read.

    Turns are ordered by turn, then role and text where turns tie; repeated rows are turns of their own. A window holds
    whole turns. It repeats the system turn (when that comes first) and at most ``history`` earlier turns, as far as the
    budget allows, without loss; every assistant text is under the loss mask once. A turn larger than the budget has a
    window of its own, which is larger. Null role or text: empty; a null conv_id is a conversation. Other columns
    don't matter, and no rows give no rows.

    Partitioned by conversation and sorted in Spark; each task streams, so a conversation of any length needs the memory
    of one window. The rows of a conversation leave together and in order.
    """

    arrow = arrow_schema(SCHEMA)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, current, rows = WordTokenizer.get(tokenizer), None, []
        tidy(tokens)
        extra = tokens.count(START + "\n" + END)
        for frame in frames:
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        rows.append(current.close())
                    current = _Windows(conv_id, budget, history)
                rows += current.add(role, text, tokens.count(escape(role)) + tokens.count(escape(text)) + extra)
            yield to_batch(rows, arrow)
            rows = []
        if current is not None:
            yield to_batch([current.close()], arrow)

    c = {x: F.col(f"`{x}`") for x in ("conv_id", "turn", "role", "text")}
    read = conversations.select(c["conv_id"].cast("long"), c["turn"], *(F.coalesce(c[x].cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SCHEMA)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a window's text."""
    return [(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "0" else m[1], r), unescape(t)) for r, t in _TURN.findall(text)]


class _Digest:
    """Of one conversation; takes its windows in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.windows = 0

    def add(self, text: str, context: int, spans) -> None:
        for role, said in read_turns(text)[context:]:
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for a, b in spans:
            said = unescape(text[a:b])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.chars += len(text)
        self.windows += 1

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows


def digest_windows(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back from their texts: counts and digests of turns and of the loss.

    ``windows`` comes straight from :func:`format_windows`, or is partitioned and sorted by conv_id and window.
    """

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    arrow, names = arrow_schema(schema), [f.split()[0] for f in SCHEMA.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for frame in frames:
            rows = []
            for values in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                x = dict(zip(names, values, strict=True))
                if now is None or now.conv_id != x["conv_id"]:
                    if now is not None:
                        rows.append(now.row())
                    now = _Digest(x["conv_id"])
                now.add(x["text"], x["context_turns"], zip(x["loss_starts"], x["loss_ends"], strict=True))
            yield to_batch(rows, arrow)
        if now is not None:
            yield to_batch([now.row()], arrow)

    return windows.select(*names).mapInArrow(run, schema)
