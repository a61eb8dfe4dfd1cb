"""Chat formatting: conversations become windows of whole turns within a token budget.

Rows are dealt by conversation and sorted by turn; from there on, formatting and reading back stream: a task
holds one window and its history, never a conversation.  While turns come in, prefix sums of their tokens
are kept; a window ends at the last turn whose prefix sum fits the budget.  Each window repeats the
system turn and as many of the latest turns as fit the history budget (found in the same prefix sums).
The loss mask covers the assistant texts that a window brings anew, so repeated targets are masked out.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles, every backslash is doubled and a backslash
goes between ``<`` and ``|``, so a text can't contain a mark; roles have line ends escaped too.  ``unescape``
reverses this exactly.

Defined results: a null text or role counts as empty; a turn over the budget gets a window of its own,
whole; equal turns of a conversation are ordered by role, then text, and all stay; rows with a null
conversation form one conversation with a null id; null turns come first; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import ship_code, sliced
from surmise.llm.bpe import NativeBpe, small_batches, tokenizer

BUDGET, HISTORY = 1024, 256
START, END = "<|im_start|>", "<|im_end|>\n"
TARGET, SYSTEM = "assistant", "system"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int]:
    """(formatted turn, where its text begins)."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}", len(head)


def parse(window: str) -> list[tuple[str, str, int]]:
    """(role, text, where the formatted text begins) of each turn, read back from a formatted window."""
    turns, at = [], 0
    while at < len(window):
        line = window.index("\n", at)
        stop = window.index(END, line)
        turns.append((unescape(window[at + len(START) : line]), unescape(window[line + 1 : stop]), line + 1))
        at = stop + len(END)
    return turns


class _Writer:
    """The windows of one conversation, as its turns come in."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None  # (rendered, text begins, target, tokens)
        self.turns: list[tuple] = []
        self.sums = [0]  # prefix sums of the held turns' tokens
        self.repeated = 0  # of the held turns, how many an earlier window has had
        self.window = 0

    def add(self, role: str, rendered: str, begins: int, tokens: int, first: bool) -> Iterator[tuple]:
        turn = (rendered, begins, role == TARGET, tokens)
        if first and role == SYSTEM:
            self.system = turn
            return
        room = self.budget - (self.system[3] if self.system else 0)
        if len(self.turns) > self.repeated and self.sums[-1] + tokens > room:
            yield self.flush()
            # the latest turns that fit the history, and with the new turn the window
            most = min(self.history, room - tokens)
            keep = len(self.turns) - bisect_left(self.sums, self.sums[-1] - most) if most > 0 else 0
            self.turns = self.turns[len(self.turns) - keep :]
            self.repeated = keep
            self.sums = [0]
            for t in self.turns:
                self.sums.append(self.sums[-1] + t[3])
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def flush(self) -> tuple:
        """(window, text, repeated turns at its start, tokens, loss spans)."""
        head = [self.system] if self.system else []
        text, spans = [], []
        at = 0
        for i, (rendered, begins, target, _) in enumerate([*head, *self.turns]):
            if target and i >= len(head) + self.repeated:
                spans.append((at + begins, at + len(rendered) - len(END)))
            text.append(rendered)
            at += len(rendered)
        repeated = self.repeated + (len(head) if self.window else 0)
        out = (self.window, "".join(text), repeated, sum(t[3] for t in [*head, *self.turns]), spans)
        self.window += 1
        return out

    def last(self) -> Iterator[tuple]:
        if len(self.turns) > self.repeated or (self.system and not self.window):
            yield self.flush()


WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int64()), ("tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
WINDOWS_DDL = "conv_id long, window long, text string, repeated long, tokens long, loss array<struct<start: long, stop: long>>"


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows of ``turns`` (conv_id, turn, role, text); a conversation's windows are neighbours, in order."""
    ship_code(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, NativeBpe)

        def rows():
            conv, writer, begun = None, _Writer(budget, history), False
            for b in sliced(batches):
                for c, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    first = not begun or c != conv
                    if first:
                        for w in writer.last():
                            yield conv, *w[:4], [{"start": x, "stop": y} for x, y in w[4]]
                        conv, writer, begun = c, _Writer(budget, history), True
                    rendered, begins = render(role or "", text or "")
                    for w in writer.add(role or "", rendered, begins, len(bpe.encode(rendered)) // 4, first):
                        yield conv, *w[:4], [{"start": x, "stop": y} for x, y in w[4]]
            for w in writer.last():
                yield conv, *w[:4], [{"start": x, "stop": y} for x, y in w[4]]

        return small_batches(rows(), WINDOWS, 2)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOWS_DDL)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: turns, what the loss mask covers, and sizes.

    ``formatted`` must hold a conversation's windows one after the other, as ``windows`` gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def rows():
            state = None
            for b in sliced(batches, 64):
                for conv, number, text, repeated, loss in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if number == 0:
                        if state:
                            yield close(state)
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, said, _ in parse(text)[repeated:]:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    for span in loss:
                        said = unescape(text[span["start"] : span["stop"]])
                        state[3] += len(said)
                        state[4].update(said.encode("utf-8", "replace"))
                    state[5] += len(text)
                    state[6] += 1
            if state:
                yield close(state)

        def close(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]

        return small_batches(rows(), pa.schema(list(zip(names, types, strict=True))), 2)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return formatted.select("conv_id", "window", "text", "repeated", "loss").mapInArrow(run, ddl)
