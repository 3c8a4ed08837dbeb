"""Chat formatting by grammar round trip.

The grammar: a conversation is a sequence of turns, a turn is ``### role:``, a line feed, the text, a line feed,
``</turn>``, a line feed. ``###`` and ``</turn>`` are control strings. Backslashes right before a control string belong
to it: with one or more of them it is text, and stands for itself with one backslash less; without any it is structure.

Each turn is first written as it is and parsed again. If the recovered turns are not the one written, its conflicting
control strings get one backslash more each, and it is parsed again until both agree. Texts without conflicts stay as
they are.

Turns are rows throughout. A conversation's rows reach one task in order (its digest and its parser are sequential) but
only stream through it, sorted by Spark; nothing holds a whole conversation.

Defined cases: null texts and roles are empty. Rows of one turn number are ordered by role, then text; a null turn comes
first. A null conversation id is one conversation. Roles may be any string. Repeated rows are turns each. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col, text_of

# The template's control strings.
OPEN, CLOSE = "###", "</turn>"
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:###|</turn>))")
LEARNT = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class ParseError(ValueError):
    """The text is not of the grammar."""


class Parser:
    """Feed formatted text in pieces of any size; ``turns`` gives (role, text, start, end) of what has been closed, places of the escaped text."""

    def __init__(self):
        self.waiting, self.at = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        self.waiting += piece
        while True:
            found = self._turn()
            if found is None:
                return
            role, raw, start, length = found
            yield role, unescape(raw), self.at + start, self.at + start + len(raw)
            self.waiting, self.at = self.waiting[length:], self.at + length

    def close(self) -> None:
        if self.waiting:
            raise ParseError("a turn is not closed")

    def _turn(self):
        head = f"{OPEN} "
        if not self.waiting.startswith(head[:len(self.waiting)]):
            raise ParseError("a turn must open")
        line = self.waiting.find(":\n")
        if line < 0:
            return None
        start = line + 2
        for control in _CONTROL.finditer(self.waiting, start):
            if control[1]:
                continue
            if control[2] == OPEN:
                raise ParseError("a turn opens in a text")
            if control.end() == len(self.waiting):
                return None
            if control.start() == start or self.waiting[control.start() - 1] != "\n" or self.waiting[control.end()] != "\n":
                raise ParseError("a turn closes within a line")
            return unquote(self.waiting[len(head):line]), self.waiting[start:control.start() - 1], start, control.end() + 1
        return None


def render(role: str, text: str) -> str:
    """One turn, escaped as far as its round trip needs."""
    name, body = quote(role, safe=" "), text
    for escaped in (False, True):
        written = f"{OPEN} {name}:\n{body}\n{CLOSE}\n"
        parser = Parser()
        try:
            recovered = [t[:2] for t in parser.feed(written)]
            parser.close()
        except ParseError:
            recovered = []
        if recovered == [(role, text)]:
            return written
        if not escaped:
            body = escape(text)
    raise ParseError(f"no round trip for a turn of {role!r}")


def formatted(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, piece)``: each turn as formatted; a conversation is its pieces in order, joined."""

    def run(batches):
        for batch in batches:
            pieces = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.string())], names=[*batch.schema.names, "piece"])

    rows = conversations.select(col(conv_id).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, piece string")


_DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


class Digest:
    """What one conversation's formatted text says, read piece by piece."""

    def __init__(self):
        self.parser, self.turns, self.chars, self.loss = Parser(), 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text, _, _ in self.parser.feed(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == LEARNT:
                self.loss += len(text)
                self.learnt.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        self.parser.close()
        return self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, all from the formatted pieces: turns and their digest, text under the loss mask and its digest, length."""

    def run(batches):
        out, now, digest = [], None, None
        for batch in batches:
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        out.append((now, *digest.row()))
                    now, digest = conv, Digest()
                digest.feed(piece)
            if len(out) > 10_000:
                yield _batch(out)
        if digest is not None:
            out.append((now, *digest.row()))
        yield _batch(out)

    def _batch(out):
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_DIGEST.fieldNames())
        out.clear()
        return made

    laid = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return laid.select("conv_id", "piece").mapInArrow(run, _DIGEST)


def loss_spans(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, start, end)`` of texts under the loss mask, places within each piece (escaped text)."""

    def run(batches):
        for batch in batches:
            found = []
            for n, piece in enumerate(batch.column(3).to_pylist()):
                found += [(n, start, end) for role, _, start, end in Parser().feed(piece) if role == LEARNT]
            rows = pa.array([n for n, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array([s for _, s, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.int64())],
                                             names=["conv_id", "turn", "role", "start", "end"])

    return turns.select("conv_id", "turn", "role", "piece").mapInArrow(run, "conv_id long, turn long, role string, start long, end long")


#: A conversation that holds the template's own control strings.
TRIAL = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) loss_sha256,
  CAST(sum(length('### ' || r || ':' || chr(10) || t || chr(10) || '</turn>' || chr(10)) + len(regexp_extract_all(t, '###|</turn>'))) AS BIGINT) formatted_chars
FROM c GROUP BY conv_id
"""


@query("op2_chat_format", _SQL)
def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.createDataFrame(TRIAL, "conv_id long, turn long, role string, text string")
    return read_back(formatted(rows.unionAll(trial)))
