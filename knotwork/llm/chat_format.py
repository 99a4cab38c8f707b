"""3. Chat formatting from an event log.

A log holds events (conversation, sequence number, message, kind, role, text): ``message`` sets a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` starts it anew for what follows, ``delete`` takes it away;
what comes behind a ``delete`` begins it again. A message's text is that of its last event of any kind but ``delta``
and of the deltas behind it; its role is the last one that isn't empty since it was last deleted; its place is that of
its first event. Events of one message are in the order of sequence number (null first), kind, role and text, and an
unknown kind counts as ``delta``. Messages of one conversation are in the order of place, role and text's hash.

``conversations`` becomes such a log as a chat service would write it: a user's text as a draft and an edit, an
assistant's as a start, a piece that breaks off, a regeneration and streamed deltas, any other's as one message.

The template marks each turn as ``<|role|>`` newline, text, ``<|end|>`` newline, role and text escaped: ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|``, so a mark can't come from a text and un-escaping gives every text back. The loss
mask of a turn is the span of the escaped text of an assistant.

Scale: the log is dealt by ranges of (conversation, message, sequence) and sorted, so neither a conversation nor a
message with a third of all rows is one task's: each task folds the runs of its events as they stream by, holding one
message's text. Folding is associative: a run gives one row, and only the first and the last of a task, whose message
may go on in another, meet again. Final messages are dealt by ranges of (conversation, place) and rendered in order;
only conversations that cross a task's border are stitched. Digests are taken from the formatted text read back.
SHA-256 is sequential, so the pieces of a crossing conversation stream through one hash in their order, a few turns in
memory at a time; a conversation inside one task is hashed there and moves as one short row.

Null text or role counts as empty; a null conversation is one; conversations without rows don't exist; events without
a message id are messages of their own. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import partitions, stored, table

EVENTS = ("conv_id", "seq", "message_id", "kind", "role", "text")
#: Kinds whose text takes the place of all before; ``delete`` takes the role too.
RESETS = ("message", "edit", "regenerate", "delete")
#: Code points of a streamed delta.
DELTA = 512
TURN = re.compile(r"<\|((?:[^<\\|]|\\.|<(?!\|)|\|)*?)\|>\n(.*?)<\|end\|>\n", re.S)
SEGMENT = "conv_id long, task long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string"
#: Characters of a crossing conversation's segment; longer ones are several rows.
SEGMENT_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render_turn(role: str, text: str) -> str:
    return f"<|{escape(role).replace('|>', '|' + chr(92) + '>')}|>\n{escape(text)}<|end|>\n"


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


class Digest:
    """What the query asks of a conversation, from formatted text that comes piece by piece, whole turns each."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for m in TURN.finditer(formatted):
            role, text = unescape(m[1]), unescape(m[2])
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text), as it stands in files, as a log: every row is a message of its own,
    named by its number in the table, and its events are numbered within its turn."""
    named = conversations.select("conv_id", "turn", F.monotonically_increasing_id().alias("message_id"), "role", F.col("text").cast("string").alias("text"))
    text, step = F.coalesce("text", F.lit("")), F.lit(DELTA)
    event = lambda n, kind, words: F.struct(F.lit(n).cast("long").alias("step"), F.lit(kind).alias("kind"), F.col("role").alias("role"), words.alias("text"))
    start = lambda i: F.substr(text, (i * step + 1).cast("int"), step)
    streamed = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / step)), lambda i: F.struct((i + 3).alias("step"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), start(i).alias("text")))
    drafted = F.array(event(0, "message", start(F.lit(0))), event(1, "edit", text))
    spoken = F.concat(F.array(event(0, "message", F.lit("")), event(1, "delta", start(F.lit(0))), event(2, "regenerate", F.lit(""))), streamed)
    events = F.when(F.col("role") == "user", drafted).when(F.col("role") == "assistant", spoken).otherwise(F.array(event(0, "message", text)))
    rows = named.select("conv_id", "turn", "message_id", F.explode(events).alias("x"))
    return rows.select("conv_id", F.struct("turn", "x.step").alias("seq"), F.col("message_id").cast("string").alias("message_id"), "x.kind", "x.role", "x.text")


class Message:
    """A run of one message's events, folded: ``cut``, whether what stands before the run is without its text,
    ``gone``, without its role too, and ``here``, whether the message is there at the end of the run."""

    __slots__ = ("cut", "gone", "here", "role", "parts")

    def __init__(self):
        self.cut, self.gone, self.here, self.role, self.parts = False, False, False, "", []

    def event(self, kind: str | None, role: str | None, text: str | None) -> None:
        if kind in RESETS:
            self.cut, self.parts = True, []
        self.here = kind != "delete"
        if self.here:
            self.role = role or self.role
            self.parts.append(text or "")
        else:
            self.gone, self.role = True, ""

    def run(self, cut: bool, gone: bool, here: bool, role: str, text: str) -> None:
        """The run that comes next, folded elsewhere."""
        if cut:
            self.parts = []
        self.cut, self.gone, self.here = self.cut or cut, self.gone or gone, here
        self.role = role if gone else role or self.role
        self.parts.append(text)

    def row(self) -> tuple:
        return self.cut, self.gone, self.here, self.role, "".join(self.parts)


def runs(rows: Iterator[tuple], add: Callable) -> Iterator[tuple[tuple, Message]]:
    """(first row, fold) of each run of rows with equal conversation and message, their first two values."""
    first, message = None, None
    for row in rows:
        if first is None or row[:2] != first[:2]:
            if first is not None:
                yield first, message
            first, message = row, Message()
        add(message, row)
    if first is not None:
        yield first, message


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about a MB; a row's last value is its text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[-1])
        if size > SEGMENT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


RUN = [("open", pa.bool_()), ("cut", pa.bool_()), ("gone", pa.bool_()), ("here", pa.bool_()), ("role", pa.string()), ("text", pa.string())]
RUN_DDL = "open boolean, cut boolean, gone boolean, here boolean, role string, text string"


def final_messages(log: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of the messages that the events of a log (EVENTS) leave; ``seq``, of any type that
    Spark can order, is that of a message's first event."""
    typed = log.select(F.col("conv_id").cast("long").alias("conv_id"), *(F.col(c).cast("string").alias(c) for c in ("message_id", "kind", "role", "text")), "seq")
    plain = typed.where("message_id is null and (kind is null or kind <> 'delete')").select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "message_id", "seq", "kind", "role", "tie"]
    dealt = typed.where("message_id is not null").withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(log.sparkSession), *order).sortWithinPartitions(*order)
    seq = typed.schema["seq"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", pa.int64()), ("message_id", pa.string()), ("seq", first.schema.field("seq").type), ("task", pa.int64()), *RUN])
        task = TaskContext.get().partitionId()

        def folds() -> Iterator[tuple]:
            before, ends = None, True  # the first run and the last may go on in other tasks
            for at, message in runs(rows_of(chain([first], batches)), lambda m, row: m.event(*row[3:])):
                if before:
                    yield (*before[0][:3], task, ends, *before[1].row())
                    ends = False
                before = at, message
            yield (*before[0][:3], task, True, *before[1].row())

        yield from batched(folds(), schema)

    found = stored(dealt.select("conv_id", "message_id", "seq", "kind", "role", "text").mapInArrow(fold, f"conv_id long, message_id string, seq {seq}, task long, {RUN_DDL}"), "runs")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([*list(first.schema)[:3], *RUN[3:]])
            folds = runs(rows_of(chain([first], batches)), lambda m, row: m.run(*row[5:]))
            yield from batched(((*at[:3], *message.row()[2:]) for at, message in folds), schema)

    # at most two runs a task
    opened = found.where("open").repartition("conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", "task")
    joined = opened.mapInArrow(join, f"conv_id long, message_id string, seq {seq}, here boolean, role string, text string")
    whole = found.where("not open").select(joined.columns).unionByName(joined).where("here")
    return plain.unionByName(whole.select("conv_id", "seq", "role", "text"))


def formatted(messages: DataFrame) -> DataFrame:
    """Segments of formatted conversations: whole ones, or in order of (task) pieces of those that cross tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, conv, parts, size, first = TaskContext.get().partitionId(), [], None, [], 0, True
        segment, alone = 0, True

        def close(last: bool) -> None:
            """A conversation inside the task becomes its digest; a piece of one that may cross, its text."""
            nonlocal parts, size, segment
            text, parts, size = "".join(parts), [], 0
            if alone and not first and not last:
                d = Digest()
                d.add(text)
                rows.append((conv, task, *d.row(), None))
            else:
                rows.append((conv, (task << 20) + segment, None, None, None, None, None, text))
                segment += 1

        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if parts and c != conv:
                    close(False)
                    first, alone = False, True
                elif size > SEGMENT_CHARS:
                    alone = False
                    close(False)
                conv = c
                parts.append(render_turn(role or "", text or ""))
                size += len(parts[-1])
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=SCHEMA)
                rows = []
        if parts:
            close(True)
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=SCHEMA)

    dealt = messages.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "seq", "role", "tie"]
    dealt = dealt.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(messages.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SEGMENT)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("formatted", pa.string())])
NAMES = SCHEMA.names


def digests(segments: DataFrame) -> DataFrame:
    """One row a conversation. Segments of the few that cross tasks stream through one hash in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if digest and row["conv_id"] != conv:
                    out.append((conv, *digest.row()))
                    digest = None
                if row["formatted"] is None:
                    out.append(tuple(row[x] for x in ("conv_id", *NAMES[2:7])))
                else:
                    conv, digest = row["conv_id"], digest or Digest()
                    digest.add(row["formatted"])
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)
                out = []
        if digest:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (conv, *digest.row())))], schema=schema)

    names = ["conv_id", *NAMES[2:7]]
    schema = pa.schema([SCHEMA.field(x) for x in names])
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "task")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) p),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS shown, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS mark FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(shown) + length(mark) + 13)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    log = as_events(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    return digests(formatted(final_messages(log)))
