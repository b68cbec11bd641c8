"""Chat formatting in budgeted windows.

The turns of a conversation are laid out in windows of at most ``budget``
tokens. Running sums of the turns' tokens choose the spans: a window takes new
turns while the sum fits, and begins with the system turn and with as much of
the history before its first new turn as fits ``history`` tokens. What is repeated is
not trained on again: the loss mask covers the assistant texts among the new
turns only. A conversation is read as a sorted stream, so its length does not
bound it; a task holds one window and the history.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageprism.llm.common import in_arrow
from pageprism.llm.tokens import Encoder

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other templates: first character and the rest.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
#: A control string with any number of backslashes behind its first character.
_CONTROL = re.compile(rf"([<\[])(\\*)(?={_REST})")
_TURN = re.compile(rf"{re.escape(BEGIN)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)

_WINDOW = (
    "conv_id bigint, window int, n_context int, n_new int, n_tokens bigint, over_budget boolean, text string,"
    " loss array<struct<start:bigint,end:bigint>>"
)
_NAMES = [c.split()[0] for c in _WINDOW.split(", ")]
_KINDS = [
    pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
]


def escape(text: str) -> str:
    """No control string is left in the result: each gets one more backslash behind its first character."""
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def _parts(role: str, text: str) -> list[str]:
    """A turn as it is written, cut where the tokenizer drops white space, so that the tokens of the parts add up to those of the whole."""
    body = escape(text)
    cut = max(body.rfind(" "), body.rfind("\n")) + 1
    return [f"{BEGIN}{_role(role)}", body[:cut], f"{body[cut:]}{END}"]


class _Turn(NamedTuple):
    role: str
    text: str
    tokens: int
    before: int  # tokens of all turns before it


class _Conversation:
    """Lays out the turns of one conversation, given in order."""

    def __init__(self, key: int | None, budget: int, history: int):
        self.key, self.budget, self.limit = key, budget, history
        self.system: _Turn | None = None
        self.past: deque[_Turn] = deque()
        self.context: list[_Turn] = []
        self.new: list[_Turn] = []
        self.used = self.total = self.window = 0

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """A window, if the turn no longer fits in it."""
        turn, done = _Turn(role, text, tokens, self.total), None
        if self.new and self.used + tokens > self.budget:
            done = self.close()
            self._open(tokens)
        if self.system is None and not self.total and role == "system":
            self.system = turn
        self.total += tokens
        self.new.append(turn)
        self.used += tokens
        self.past.append(turn)
        while self.past and self.total - self.past[0].before > self.limit:
            self.past.popleft()
        return done

    def _open(self, tokens: int) -> None:
        system = [self.system] if self.system else []
        room = self.budget - tokens - sum(t.tokens for t in system)
        self.context = system + [t for t in self.past if t is not self.system and self.total - t.before <= room]
        self.new, self.used = [], sum(t.tokens for t in self.context)

    def close(self) -> tuple | None:
        if not self.new:
            return None
        parts, loss, at = [], [], 0
        for i, t in enumerate([*self.context, *self.new]):
            head, body = f"{BEGIN}{_role(t.role)}\n", escape(t.text)
            if i >= len(self.context) and t.role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, f"{END}\n"]
            at += len(head) + len(body) + len(END) + 1
        row = (self.key, self.window, len(self.context), len(self.new), self.used, self.used > self.budget, "".join(parts), loss)
        self.window += 1
        return row


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def chat_windows(turns: DataFrame, tokenizer: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: ``text``, ``loss`` (spans of code points), the number of repeated turns at its head and of new ones.

    Turns (``conv_id``, ``turn``, ``role``, ``text``) are taken in order of
    ``turn`` (null first), then role and text; repeated rows are turns of their
    own. Null roles and texts are empty, rows without ``conv_id`` form one
    conversation. The system turn is a first turn of that role. ``n_tokens`` counts the window as it is written,
    marks and escapes included, for a tokenizer that drops white space and never looks across it. A turn longer
    than the budget is never cut: its window holds it with the system turn
    alone and is marked ``over_budget``. Other columns are not looked at; an
    empty table gives no windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, rows = Encoder.of(tokenizer), None, []
        for batch in batches:
            keys, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            for a in range(0, len(keys), 1024):
                part = slice(a, a + 1024)
                written = [_parts(role, text) for role, text in zip(roles[part], texts[part], strict=True)]
                each = [[len(ids) // 4 for ids in encoder.encode(list(p))] for p in zip(*written, strict=True)]
                for key, role, text, *size in zip(keys[part], roles[part], texts[part], *each, strict=True):
                    if now is None or now.key != key:
                        rows += [r for r in [now.close() if now else None] if r]
                        now = _Conversation(key, budget, history)
                    if done := now.add(role, text, sum(size)):
                        rows.append(done)
                if rows:
                    yield _batch(rows, _NAMES, _KINDS)
                    rows = []
        if now and (done := now.close()):
            yield _batch([done], _NAMES, _KINDS)

    ordered = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").alias("turn"),
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(ordered.select("conv_id", "role", "text"), run, _WINDOW)


def read_turns(text: str, n_context: int) -> list[tuple[str, str]]:
    """Role and text of each new turn of a window."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(text)][n_context:]


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: number and digest of turns, digest of the text under the loss mask, size."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, rows = False, None, []
        count = chars = size = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def row() -> tuple:
            return (key, count, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in batches:
            for conv, context, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not started or conv != key:
                    if started:
                        rows.append(row())
                    started, key, count, chars, size = True, conv, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, body in read_turns(text, context):
                    count += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    chars += len(body)
                    loss.update(body.encode())
                size += len(text)
            if rows:
                yield _batch(rows, names, kinds)
                rows = []
        if started:
            yield _batch([row()], names, kinds)

    ordered = windows.select("conv_id", "n_context", "text", "loss", "window").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return in_arrow(ordered.select("conv_id", "n_context", "text", "loss"), run, schema)
