"""Chat formatting in budgeted windows.

A conversation becomes one or more training texts. Running sums of turn tokens choose spans of whole turns that fit a
token budget; every window starts with the conversation's system turn, repeats a limited number of earlier turns as
context, and masks their text, so that every assistant text is a target exactly once.

Rows are dealt by conversation, sorted within their partition and streamed: a task holds one window and its history,
never a whole conversation, so even a conversation with a third of all rows needs no more memory than others. The
reader checks the same way: it parses the formatted texts and digests what it finds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm import tokens

#: Marks of the template (ChatML). Texts can hold these and other templates' control strings; they are escaped.
START, END = "<|im_start|>", "<|im_end|>\n"
#: A control string is a bracket and one of these tails: <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_PLAIN, _ESCAPED = re.compile(r"([<\[])(\\*)" + _TAIL), re.compile(r"([<\[])\\(\\*)" + _TAIL)
_TURN = re.compile(r"<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Put a backslash after the bracket of every control string, with or without backslashes there already."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`: take one backslash away."""
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text begins and ends in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


WINDOWS = [
    ("window", T.LongType()), ("text", T.StringType()), ("n_tokens", T.LongType()), ("n_repeated", T.IntegerType()),
    ("loss_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
]


class _Window:
    """What a task holds of the conversation it is in."""

    def __init__(self, budget: int, history: int, share: float, vocabulary: bytes):
        self.vocabulary = vocabulary
        self.budget, self.history, self.room = budget, history, int(budget * share)
        self.system: tuple[str, str, int] | None = None
        self.first, self.number, self.past = True, 0, []
        self.repeated: list[tuple[str, str, int]] = []
        self.turns: list[tuple[str, str, int]] = []
        self.total = self.start = 0  # running sums: tokens of all turns so far, and at the window's first new turn

    def add(self, role: str, text: str) -> dict | None:
        """Take the next turn; the window before it if that is complete."""
        turn, done = (role, text, tokens.count(format_turn(role, text)[0], self.vocabulary)), None
        context = sum(t[2] for t in self.repeated)
        if self.turns and context + self.total - self.start + turn[2] > self.budget:
            done = self.flush()
            self.repeated = [self.system] if self.system else []
            room, recent = min(self.room, self.budget - turn[2] - sum(t[2] for t in self.repeated)), []
            for old in reversed(self.past[-self.history:] if self.history else []):
                if old is self.system or old[2] > room:
                    break
                room -= old[2]
                recent.append(old)
            self.repeated += reversed(recent)
            self.start = self.total
        if self.first and role == "system":
            self.system = turn
        self.first = False
        self.total += turn[2]
        self.turns.append(turn)
        self.past = [*self.past[-self.history:], turn] if self.history else []
        return done

    def flush(self) -> dict:
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate([*self.repeated, *self.turns]):
            part, a, b = format_turn(role, text)
            if role == "assistant" and k >= len(self.repeated):
                spans.append([at + a, at + b])
            parts.append(part)
            at += len(part)
        out = {"window": self.number, "text": "".join(parts), "n_tokens": sum(t[2] for t in [*self.repeated, *self.turns]), "n_repeated": len(self.repeated), "loss_spans": spans}
        self.number += 1
        self.turns = []
        return out


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 2, history_share: float = 0.25, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """One row for each window: conv, window (from 0), text, n_tokens, n_repeated (turns repeated at its start) and
    loss_spans ([from, to) in code points of the text: the assistant texts that are targets here).

    A window holds at most ``budget`` tokens of the vocabulary, each formatted turn counted by itself, unless its system turn and one new turn alone are longer: turns are never
    cut. Turns are taken in order of (turn, role, text), nulls first; null roles and texts are empty, a null
    conversation id is a conversation, repeated rows are turns of their own, an empty table gives no rows. Only the four
    named columns are read. Within a partition, windows of a conversation stand together and in order.
    """
    kind, vocabulary = turns.schema[conv].dataType, turns.sparkSession.sparkContext.broadcast(tokens.vocabulary(tokenizer))
    schema = T.StructType([_field(conv, kind), *(_field(*f) for f in WINDOWS)])
    arrow = pa.schema([(conv, _arrow(kind)), ("window", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_repeated", pa.int32()), ("loss_spans", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows, size = None, None, [], 0
        for batch in batches:
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if state is None or c != now:
                    if state:
                        rows.append({conv: now} | state.flush())
                    now, state = c, _Window(budget, history, history_share, vocabulary.value)
                if done := state.add(r or "", t or ""):
                    rows.append({conv: now} | done)
                    size += len(done["text"])
                if len(rows) >= 1000 or size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        if state:
            rows.append({conv: now} | state.flush())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    dealt = turns.select(F.col(conv), F.col(role).cast("string").alias("_role"), F.col(text).cast("string").alias("_text"), F.col(turn).alias("_turn"))
    dealt = dealt.repartition(F.col(conv)).sortWithinPartitions(F.col(conv), F.col("_turn"), "_role", "_text")
    return dealt.select(conv, "_role", "_text").mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def parse_window(text: str) -> list[tuple[str, str]]:
    """The (role, text) of each formatted turn; the whole text must be turns."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        assert m.start() == at, "text between turns"
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    assert at == len(text), "text after the last turn"
    return out


def read_back(windows: DataFrame, conv: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Digests of each conversation, from its formatted windows alone.

    n_turns, turns_sha256 (role, newline, text, newline for each turn that is not repeated), loss_chars and loss_sha256
    (unescaped text under the loss mask), formatted_chars, n_windows. ``in_order``: the rows come straight from
    :func:`format_windows`; otherwise they are dealt and sorted anew.
    """
    schema = T.StructType([_field(conv, windows.schema[conv].dataType), *(_field(n, T.StringType() if "sha" in n else T.LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"))])

    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s, rows = None, None, []

        def end() -> dict:
            return {conv: now, "n_turns": s["n"], "turns_sha256": s["t"].hexdigest(), "loss_chars": s["c"], "loss_sha256": s["l"].hexdigest(), "formatted_chars": s["f"], "n_windows": s["w"]}

        for batch in batches:
            for c, text, repeated, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s is None or c != now:
                    if s:
                        rows.append(end())
                    now, s = c, {"n": 0, "t": hashlib.sha256(), "c": 0, "l": hashlib.sha256(), "f": 0, "w": 0}
                for r, t in parse_window(text)[repeated:]:
                    s["n"] += 1
                    s["t"].update(f"{r}\n{t}\n".encode())
                for a, b in spans:
                    loss = unescape(text[a:b])
                    s["c"] += len(loss)
                    s["l"].update(loss.encode())
                s["f"] += len(text)
                s["w"] += 1
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if s:
            rows.append(end())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    if not in_order:
        windows = windows.repartition(F.col(conv)).sortWithinPartitions(conv, "window")
    return windows.select(conv, "text", "n_repeated", "loss_spans").mapInArrow(run, schema)


def op4(conversations: DataFrame) -> DataFrame:
    """The digest over all conversations and conversation -1, read back from the formatted windows."""
    spark = conversations.sparkSession
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return read_back(format_windows(turns.unionByName(extra)), in_order=True)
