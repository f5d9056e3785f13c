"""Chat formatting in budgeted windows.

A conversation is laid out as windows of whole turns. Sums of the turns' tokens choose where a window ends; every
window repeats the system turn and a limited stretch of the turns before it, and only turns that are new in it are
under the loss mask.
"""

from __future__ import annotations

import re
import sys
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import column_udf
from shelfcast.llm.tokens import Encoder
from shelfcast.session import ship_by_value

ship_by_value(sys.modules[__name__])

BUDGET_TOKENS = 1024
HISTORY_TOKENS = 256
#: Rows of windows in one output batch.
BATCH_ROWS = 256

BEGIN, END = "<|im_start|>", "<|im_end|>"
# "<", any number of backslashes, "|": one backslash more or less turns control strings into text and back.
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

WINDOW_SCHEMA = (
    "conv_id bigint, window bigint, first_turn bigint, n_turns bigint, repeated_turns bigint, n_tokens bigint, "
    "text string, loss array<struct<start:int,end:int>>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Window:
    """The window being filled of one conversation."""

    system: Turn | None = None
    repeated: list[Turn] = field(default_factory=list)
    new: list[Turn] = field(default_factory=list)
    tokens: int = 0
    number: int = 0
    turn: int = 0  # turns of the conversation before the new ones


def laid_out(turns: list[Turn], repeated: int) -> tuple[str, list[dict[str, int]]]:
    """Formatted turns, and the spans of the assistant's texts from the turn number ``repeated`` on."""
    parts, loss, at = [], [], 0
    for i, turn in enumerate(turns):
        head, body = f"{BEGIN}{escape_role(turn.role)}\n", escape(turn.text)
        if i >= repeated and turn.role == "assistant" and body:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def turn_tokens(turns: pa.Array, encoder: Encoder) -> pa.Array:
    """Tokens of each formatted turn (role, text)."""
    frame, out = len(encoder.ids(f"{BEGIN}{END}\n")), []
    for role, text in zip(turns.field("role").to_pylist(), turns.field("text").to_pylist(), strict=True):
        out.append(frame + len(encoder.ids(f"{escape_role(role)}\n")) + len(encoder.ids(escape(text))))
    return pa.array(out, pa.int64())


class WindowWriter:
    """Turns of conversations in order come in, windows go out; holds one window at a time."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.conv, self.open = None, None
        self.recent: deque[Turn] = deque()

    def turn(self, conv, role: str, text: str, tokens: int) -> Iterator[dict]:
        if self.open is None or conv != self.conv:
            yield from self.close()
            self.conv, self.open, self.recent = conv, Window(), deque()
        turn, w = Turn(role, text, tokens), self.open
        if w.new and w.tokens + tokens > self.budget:
            yield self._row()
            self.open = w = self._next(tokens)
        elif w.number == 0 and w.turn == 0 and not w.new and role == "system":
            w.system = turn
        w.new.append(turn)
        w.tokens += tokens
        self.recent.append(turn)
        held = sum(t.tokens for t in self.recent)
        while len(self.recent) > 1 and held - self.recent[0].tokens >= self.history:
            held -= self.recent.popleft().tokens

    def _next(self, tokens: int) -> Window:
        """A new window with the system turn and as many of the last turns as history and budget allow."""
        old = self.open
        w = Window(system=old.system, number=old.number + 1, turn=old.turn + len(old.new))
        room = self.budget - tokens - (w.system.tokens if w.system else 0)
        room, past = min(room, self.history), []
        for t in reversed(self.recent):
            if t is w.system or t.tokens > room:
                break
            room -= t.tokens
            past.append(t)
        w.repeated = ([w.system] if w.system else []) + past[::-1]
        w.tokens = sum(t.tokens for t in w.repeated)
        return w

    def _row(self) -> dict:
        w = self.open
        text, loss = laid_out(w.repeated + w.new, len(w.repeated))
        return {
            "conv_id": self.conv, "window": w.number, "first_turn": w.turn, "n_turns": len(w.repeated) + len(w.new),
            "repeated_turns": len(w.repeated), "n_tokens": w.tokens, "text": text, "loss": loss,
        }

    def close(self) -> Iterator[dict]:
        if self.open is not None and self.open.new:
            yield self._row()
        self.open = None


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_WINDOWS = pa.schema(
    [(k, pa.int64()) for k in ("conv_id", "window", "first_turn", "n_turns", "repeated_turns", "n_tokens")]
    + [("text", pa.string()), ("loss", pa.list_(_SPAN))]
)


def format_windows(
    conversations: DataFrame,
    tokenizer: str,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET_TOKENS,
    history: int = HISTORY_TOKENS,
) -> DataFrame:
    """Windows of at most ``budget`` tokens (WINDOW_SCHEMA), in order within each partition; ``loss`` holds the
    spans of ``text`` under the loss mask (code points, end exclusive).

    A turn reads ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. Inside texts ``<|`` is
    written ``<\\|`` (with backslashes between, one more), so no text can end its turn; ``read_turns`` reverses it.
    A window ends before the turn that would exceed the budget; the next one repeats the system turn (if that was
    the conversation's first) and the last turns that fit in ``history`` tokens and in the budget. Repeated turns
    are never under the mask. A turn beyond the budget is a window's only new one, never cut.

    Turns are ordered by number, then role and text, null numbers first. Null texts and roles are empty; rows of
    a null conversation form one conversation of that id; repeated rows are repeated turns. Conversations are
    streamed in order: a task holds one window, however long the conversation. An empty table gives an empty one.
    """
    encoder, columns = Encoder(tokenizer), ["conv", "role", "text", "tokens"]
    count = column_udf(lambda turns: turn_tokens(turns, encoder), "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            writer = WindowWriter(budget, history)
            for batch in batches:
                for turn in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
                    yield from writer.turn(*turn)
            yield from writer.close()

        return _batches(rows(), _WINDOWS)

    turns = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # tokens are counted where the rows lie, before a long conversation's turns come together
    counted = turns.withColumn("tokens", count(F.struct("role", "text")))
    ordered = counted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select(*columns).mapInArrow(run, WINDOW_SCHEMA)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
