"""Chat formatting (operator 12): event-sourced reconstruction and rendering.

A log has one row per event: ``conv_id``, ``turn`` (the message's place), ``kind``,
``role``, ``text`` and the columns that order the events of a turn.

1. *Partition and sort.*  Events are range-partitioned by (conv_id, turn) and sorted
   by (conv_id, turn, sequence).  A conversation of any length is spread over
   several partitions; all events of one turn are together.
2. *Fold.*  ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces
   its text, ``regenerate`` discards it for the deltas that follow.  One message is
   held at a time.
3. *Render.*  A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings in
   texts and roles are escaped: ``&`` becomes ``&amp;`` and the first character of a
   control string (``<`` or ``[``) an entity, so no marker can come out of a text
   and the text can be restored.  The loss mask lists the spans of the assistants'
   texts.  A conversation is one row, or several of about ``SEGMENT_CHARS`` each,
   cut between turns, in the order of (turn, part).

``read_back`` parses formatted segments to turns and digests.  Conversations that
one task rendered as a single segment are read where they lie.  Only those cut by
a segment or a partition border (``whole`` is false; at most two a partition, and
those above ``SEGMENT_CHARS``) are shuffled again; their segments pass through one
task, one at a time, because a SHA-256 is sequential.

Defined cases: a null text is empty, a null role the empty role; a null ``conv_id``
is a conversation of its own, a null ``turn`` comes first.  Unknown and null kinds
append like a delta, and an event without an open message opens one.  Several
``message`` events of a turn are several messages.  Extra columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored

START, END = "<|im_start|>", "<|im_end|>"
# Strings that chat templates give a meaning.
CONTROLS = (START, END, "<|im_sep|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
            "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>",
            "[INST]", "[/INST]")
ENTITIES = {"&": "&amp;", "<": "&lt;", "[": "&lsqb;", "\n": "&newline;"}
SEGMENT_CHARS = 1 << 20
BATCH_CHARS = 1 << 22
DELTA_CHARS = 512

_CONTROL = re.compile("&|" + "|".join(map(re.escape, CONTROLS)))
_ENTITY = re.compile("|".join(map(re.escape, ENTITIES.values())))
_PLAIN = {v: k for k, v in ENTITIES.items()}
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ENTITIES[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return _ENTITY.sub(lambda m: _PLAIN[m[0]], text)


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, turn, kind, role, text) in order to (conv_id, turn, role, text) of
    the final messages."""
    at, role, parts = None, None, None
    for conv, turn, kind, who, text in events:
        if parts is not None and (kind == "message" or at != (conv, turn)):
            yield *at, role, "".join(parts)
            parts = None
        if parts is None:
            at, role, parts = (conv, turn), who or "", [text or ""]
        elif kind in ("edit", "regenerate"):
            parts = [text or ""]
        else:
            parts.append(text or "")
    if parts is not None:
        yield *at, role, "".join(parts)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = f"{START}{escape(role).replace('\n', ENTITIES['\n'])}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted segment."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def segments(messages: Iterable[tuple], segment_chars: int = SEGMENT_CHARS) -> Iterator[tuple]:
    """Messages of one partition to rows (conv_id, turn, part, whole, formatted,
    n_turns, loss); ``whole`` if the conversation is this segment and neither the
    first nor the last conversation of the partition."""
    conv, part, first_conv = None, 0, True
    pieces, size, turn, loss, cut = None, 0, None, [], False

    def row(whole: bool) -> tuple:
        return conv, turn, part, whole, "".join(pieces), len(pieces), loss

    for c, t, role, text in messages:
        if pieces is not None and (c != conv or size >= segment_chars):
            yield row(c != conv and not cut and not first_conv)
            part += 1
            first_conv, cut = (first_conv and c == conv), c == conv
            pieces = None
        if pieces is None:
            conv, turn, pieces, size, loss = c, t, [], 0, []
        piece, start, end = render_turn(role, text)
        if role == "assistant":
            loss.append({"start": size + start, "end": size + end})
        pieces.append(piece)
        size += len(piece)
    if pieces is not None:
        yield row(False)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterable[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded weight."""
    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += weigh(r)
        if weight >= BATCH_CHARS:
            yield batch(held)
            held, weight = [], 0
    if held:
        yield batch(held)


def _kinds(df: DataFrame, *names: str) -> list[str]:
    types = dict(df.dtypes)
    return [types[n] for n in names]


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]


def format_log(events: DataFrame, sequence: Sequence[str] = ("seq",), segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Formatted segments: conv_id, turn (of the first message), part, whole,
    formatted, n_turns, loss (spans of ``formatted`` under the loss mask)."""
    conv, turn = _kinds(events, "conv_id", "turn")
    schema = pa.schema([("conv_id", _arrow(conv)), ("turn", _arrow(turn)), ("part", pa.int64()), ("whole", pa.bool_()),
                        ("formatted", pa.string()), ("n_turns", pa.int64()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(segments(fold(_rows(batches)), segment_chars), schema, lambda r: 64 + len(r[4]))

    dealt = events.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", *sequence)
    return dealt.select("conv_id", "turn", "kind", "role", "text").mapInArrow(
        render, f"conv_id {conv}, turn {turn}, part bigint, whole boolean, formatted string, n_turns bigint, "
                "loss array<struct<start:bigint,end:bigint>>")


def _digests(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, formatted, loss) segments in order to one row a conversation."""
    conv, n, started = None, 0, False
    turns = masked = None
    loss_chars = chars = 0
    for c, formatted, loss in rows:
        if not started or c != conv:
            if started:
                yield conv, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars
            conv, n, started, loss_chars, chars = c, 0, True, 0, 0
            turns, masked = hashlib.sha256(), hashlib.sha256()
        for role, text in parse(formatted):
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            n += 1
        for span in loss:
            text = unescape(formatted[span["start"]:span["end"]])
            masked.update(text.encode("utf-8", "surrogatepass"))
            loss_chars += len(text)
        chars += len(formatted)
    if started:
        yield conv, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, all taken from the formatted segments."""
    (conv,) = _kinds(formatted, "conv_id")
    schema = pa.schema([("conv_id", _arrow(conv)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_digests(_rows(batches)), schema, lambda r: 512)

    def digests(segments: DataFrame) -> DataFrame:
        return segments.select("conv_id", "formatted", "loss").mapInArrow(
            digest, f"conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                    "formatted_chars bigint")

    cut = formatted.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return digests(formatted.where("whole")).unionByName(digests(cut))


def as_events(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log of finished conversations: each row opens a message and streams its
    text in deltas.  Rows of one turn are ordered by role and text hash; copies are
    told apart by a row number of the scan (every row's events are made together)."""
    rows = conversations.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("tie"),
                                F.monotonically_increasing_id().alias("row"))
    chunks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    log = F.concat(F.array(event("message", F.lit(""))), F.transform(chunks, lambda t: event("delta", t)))
    each = rows.select("conv_id", "turn", "role", "tie", "row", F.posexplode(log).alias("at", "event"))
    return each.select("conv_id", "turn", "role", "tie", "row", "at", "event.kind", "event.text")


SEQUENCE = ("role", "tie", "row", "at")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted segments of a table of messages, written to the scratch folder."""
    return stored(format_log(as_events(conversations), SEQUENCE), "chat-formatted")


def oracle_sql(table: str = "conversations", extra: Sequence[tuple] = ()) -> str:
    """DuckDB: the digests from the messages themselves (turns without ties), and the
    length of the formatted text; ``extra`` rows join the table."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        s = f"replace({column}, '&', '&amp;')"
        for first in "<[":
            rest = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)
            s = f"regexp_replace({s}, {quoted(re.escape(first) + '(' + rest + ')')}, {quoted(ENTITIES[first] + chr(92) + '1')}, 'g')"
        return s

    more = "".join(f" UNION ALL SELECT {c}, {t}, {quoted(r)}, {quoted(x)}" for c, t, r, x in extra)
    fixed = len(START) + len(END) + 2
    role = f"replace({escaped('role')}, chr(10), {quoted(ENTITIES[chr(10)])})"
    return f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM (SELECT conv_id, turn, role, text FROM {table}{more})),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum({fixed} + length({role}) + length({escaped('text')})) AS formatted_chars
      FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::bigint AS formatted_chars FROM a"""
