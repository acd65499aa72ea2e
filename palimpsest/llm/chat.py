"""Chat formatting from event logs: messages are folded from their events, rendered, and can be parsed back.

Events: conv_id, seq, message (order of the message in its conversation), kind, role, text. Kinds:
  message     a whole message; always begins a new one
  delta       text appended to the message, which it begins if need be
  edit        replaces the message's text
  regenerate  empties the message and drops what later messages got before it; deltas after it fill it anew
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import prepare

# The template's marks, and control strings of other templates that a text must not smuggle in.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_control = re.compile("|".join(map(re.escape, CONTROL)))
_escaped = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string; no control string is left."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"{START}{escape(role)}{MIDDLE}{escape(text)}{END}"


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, first and end of the text's span) of each turn; raises ValueError where the marks are out of order."""
    at = 0
    while at < len(formatted):
        middle = formatted.find(MIDDLE, at)
        end = formatted.find(END, middle)
        if not formatted.startswith(START, at) or middle < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        a = middle + len(MIDDLE)
        yield unescape(formatted[at + len(START) : middle]), unescape(formatted[a:end]), a, end
        at = end + len(END)


class Fold:
    """Final messages from events sorted by (conversation, message, seq). Holds one message at a time.

    Whatever seq a message's `regenerate` has, later messages lose their events up to there; as messages come in
    order, the largest such seq so far is all that has to be remembered.
    """

    def __init__(self):
        self.conv, self.at, self.cut, self.next_cut = (), None, None, None
        self.role, self.parts, self.n = "", None, 0

    def _flush(self):
        if self.parts is not None:
            yield self.conv[0], self.n, self.role, "".join(self.parts)
            self.n += 1
        self.parts = None

    def add(self, conv, seq, message, kind, role, text):
        if self.conv != (conv,):
            yield from self._flush()
            self.conv, self.at, self.cut, self.next_cut, self.n = (conv,), (message,), None, None, 0
        elif self.at != (message,):
            yield from self._flush()
            self.at, self.cut = (message,), self.next_cut
        if self.cut is not None and (seq is None or seq < self.cut):
            return
        if kind == "message":
            yield from self._flush()
            self.role, self.parts = role, [text]
        elif kind == "delta":
            if self.parts is None:
                self.role, self.parts = role, []
            self.parts.append(text)
        elif kind == "edit":
            self.role, self.parts = (role or self.role) if self.parts is not None else role, [text]
        elif kind == "regenerate":
            self.role, self.parts = (role or self.role) if self.parts is not None else role, []
            if seq is not None:
                self.next_cut = seq if self.next_cut is None else max(seq, self.next_cut)
        else:
            raise ValueError(f"unknown event {kind!r}")

    def close(self):
        yield from self._flush()


TURNS = "conv_id long, position long, role string, text string, formatted string, loss_start long, loss_end long"


def _batches(rows: Iterator[tuple], most: int = 2048, most_chars: int = 4 << 20):
    """Arrow batches of bounded size."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[3]) + len(r[4])
        if len(held) >= most or chars >= most_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each final message, in order: conv_id, position, role, text, formatted, loss_start, loss_end.

    The formatted conversation is its rows' `formatted` joined with nothing between; [loss_start, loss_end) is the
    span of `formatted` under the loss mask, empty for other roles. Events are shuffled by conversation and streamed
    in sorted order, so a conversation of any length holds one message in memory; one conversation stays one task, as
    its order is what is computed.

    A null text or role is empty, a null kind `message`; null conv_ids are one conversation; null seqs and messages
    come first; equal sort keys are ordered by kind, role and text. Repeated rows are events of their own. An empty table
    gives an empty result. Other columns are ignored.
    """
    prepare(events.sparkSession)

    def folded(batches):
        fold = Fold()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield from fold.add(*row)
        yield from fold.close()

    def turns(batches):
        for conv, n, role, text in folded(batches):
            out = render(role, text)
            a, b = (out.index(MIDDLE) + len(MIDDLE), len(out) - len(END)) if role == loss_role else (0, 0)
            yield conv, n, role, text, out, a, b

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for rows in _batches(turns(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in TURNS.split(", ")])

    empty = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c)
    rows = events.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "seq", "message")), empty("kind", "message"), empty("role"), empty("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "message", "seq", "kind", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """What format_chats made, read back from `formatted`: one row per conversation. Takes its rows as it orders them."""

    def run(batches):
        def done():
            return [(conv[0], n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars)]

        conv, out = None, []
        for batch in batches:
            for c, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if conv != (c,):
                    out += done() if conv else []
                    conv, n, chars, loss_chars = (c,), 0, 0, 0
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in parse(text):
                    n += 1
                    turns_hash.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                under = unescape(text[a:b])
                loss_chars += len(under)
                loss_hash.update(under.encode("utf-8", "surrogatepass"))
                chars += len(text)
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        out += done() if conv else []
        if out:
            yield _rows(out)

    return turns.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as events: each a whole message, in the order of turns."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message"), F.lit("message").alias("kind"), "role", "text")
