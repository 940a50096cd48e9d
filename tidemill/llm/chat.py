"""Chat logs folded into conversations and rendered with a reversible template.

A log is a table of events: a message is opened, streamed deltas append to it,
an edit replaces its text, a regeneration drops it and all after it. What a
message's own events say follows from windows over its key: which of them come
after its last edit, and where it was opened. Regenerations alone are then sorted
by conversation and sequence and tell which stretches of a conversation have
gone. Last, what is left is sorted the same way and folded as it streams by, so a
task keeps one message. The formatted output is one row per message, in order,
so that a conversation of any length needs no single row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.work import checkpoint_dir, settled, small

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
EVENT_TYPE = "conv bigint, seq bigint, part int, kind string, message string, role string, body string"
#: A message of the formatted output; the mask is whether its text counts for the loss.
PIECE = "conv bigint, place bigint, piece string, mask boolean"
#: A text that becomes events is streamed in deltas of so many characters.
DELTA_CHARS = 512
#: Equal rows that are numbered at once, and numbers of repeated rows that go to all tasks instead of being joined by a shuffle.
EQUAL, BROADCAST_ROWS = 1_024, 200_000

#: Marks before and after a text, by role; other roles are named in theirs.
MARKS = {
    "user": ("<s>[INST] ", " [/INST]"),
    "assistant": ("<s>[ANS] ", " [/ANS]</s>"),
    "system": ("<s><<SYS>>\n", "\n<</SYS>>"),
}
OTHER = ("<s><<ROLE ", ">>\n", "\n<</ROLE>>")
_CONTROL = re.compile(r"<(?=/?s>|</?(?:SYS|ROLE)|/?(?:SYS|ROLE)>)|\[(?=/?(?:INST|ANS)\])|>(?=>)")


def escape(text: str) -> str:
    """The text with backslashes doubled and one put into each control string, so that none is left in it."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.?)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + escape(text) + MARKS[role][1]
    return OTHER[0] + escape(role) + OTHER[1] + escape(text) + OTHER[2]


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    for role, (head, tail) in MARKS.items():
        if piece.startswith(head):
            return role, unescape(piece[len(head) : -len(tail)])
    name, text = piece[len(OTHER[0]) : -len(OTHER[2])].split(OTHER[1], 1)
    return unescape(name), unescape(text)


def _key(seq, message, part) -> tuple:
    """A place in a conversation, to compare; nulls come first, as in Spark's order."""
    return (seq is not None, seq or 0, message is not None, message or "", part is not None, part or 0)


class Gone:
    """The stretches of one conversation that its regenerations drop, while these go by in order."""

    def __init__(self):
        self.starts: list[tuple] = []
        self.ends: list[tuple] = []

    def take(self, start: tuple, end: tuple) -> None:
        """A regeneration at ``end`` of a message opened at ``start``: nothing, if that has gone; else all since then goes."""
        k = bisect_right(self.starts, start)
        if k and start < self.ends[k - 1]:
            return
        del self.starts[k:], self.ends[k:]  # what went since then lies within
        self.starts.append(start)
        self.ends.append(end)


_AT = ("conv", "open_seq", "message", "open_part")
_GONE = "conv bigint, open_seq bigint, message string, open_part int, until_seq bigint, until_message string, until_part int"


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _stretches(batches):
    conv, state = object(), None
    names = _GONE.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32()]

    def told():
        rows = [] if state is None else [(conv, *(x[i + 1] if x[i] else None for x in pair for i in (0, 2, 4))) for pair in zip(state.starts, state.ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    for batch in batches:
        for c, open_seq, message, open_part, seq, part in _columns(batch, *_AT, "seq", "part"):
            if state is None or c != conv:
                yield told()
                conv, state = c, Gone()
            state.take(_key(open_seq, message, open_part), _key(seq, message, part))
    yield told()


def _fold(batches):
    """Rows of messages and of stretches that have gone, by place, to final messages."""
    conv, message, role, parts, place, until = object(), None, "", [], 0, None
    out: list[tuple] = []

    def done():
        nonlocal message, place
        if message is not None:
            out.append((conv, place, render(role, "".join(parts)), role == "assistant"))
            message, place = None, place + 1

    for batch in batches:
        for c, open_seq, name, open_part, marks, until_seq, until_message, until_part, said, body in _columns(batch, *_AT, "marks", "until_seq", "until_message", "until_part", "role", "body"):
            if c != conv:
                done()
                conv, place, until = c, 0, None
            at = _key(open_seq, name, open_part)
            if marks:
                done()
                until = _key(until_seq, until_message, until_part)
            elif until is None or at >= until:
                if message != at:
                    done()
                    message, role, parts = at, said or "", []
                parts.append(body or "")
        yield _pieces(out)
        out.clear()
    done()
    yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv", pa.int64()), ("place", pa.int64()), ("piece", pa.string()), ("mask", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _placed(events: DataFrame) -> DataFrame:
    """events with where their message was opened last before them, and last of all, and its last edit since; each as a struct that begins with seq and part."""
    of_message = Window.partitionBy("conv", "message")
    so_far = of_message.orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unopened = (F.col("kind") == DELTA) & (F.row_number().over(of_message.orderBy("seq", "part")) == 1)
    at = F.struct("seq", "part", "role")
    placed = events.withColumn("opens", (F.col("kind") == OPEN) | unopened)
    placed = placed.withColumn("opened", F.max(F.when(F.col("opens"), at)).over(so_far))
    edit = F.when(F.col("kind") == EDIT, F.struct("opened", F.struct("seq", "part").alias("at")))  # those of the last opening come last
    return placed.withColumns({"last": F.max("opened").over(of_message), "edit": F.max(F.when(F.col("opened").isNotNull(), edit)).over(of_message)})


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages, rendered: (conv, place, piece, mask), in order within each partition.

    events has the columns of EVENT_TYPE. Of a conversation they apply by seq,
    then message, then part; a message is known by its name in its conversation,
    and opening it again starts it anew at that place. The first event of a
    message opens it if it is a delta; edits and regenerations of messages that
    were never opened do nothing, nor do those of messages that have gone.
    Events that repeat apply each time. Null roles and bodies are empty; events
    without a conversation form their own; texts of any length are one message
    each. An empty log gives no pieces. Other columns aren't read.
    """
    placed = _placed(events.select(*[x.split(" ")[0] for x in EVENT_TYPE.split(", ")])).where("opened IS NOT NULL")
    where = ["conv", F.col("opened.seq").alias("open_seq"), "message", F.col("opened.part").alias("open_part")]
    regenerated = placed.where(F.col("kind") == REGENERATE).select(*where, "seq", "part")
    gone = regenerated.repartition("conv").sortWithinPartitions("conv", "seq", "message", "part").mapInArrow(_stretches, _GONE)
    edited = F.col("edit.opened") == F.col("last")
    current = (F.col("opened") == F.col("last")) & (~F.coalesce(edited, F.lit(False)) | (F.struct("seq", "part") >= F.col("edit.at")))
    said = placed.where((F.col("kind") != REGENERATE) & current).select(
        *where, F.lit(False).alias("marks"), F.lit(None).cast("bigint").alias("until_seq"), F.lit(None).cast("string").alias("until_message"),
        F.lit(None).cast("int").alias("until_part"), "seq", "part", F.col("opened.role").alias("role"), "body",
    )
    nothing = {"seq": "bigint", "part": "int", "role": "string", "body": "string"}
    marks = gone.select(*_AT, F.lit(True).alias("marks"), "until_seq", "until_message", "until_part", *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    return said.union(marks).repartition("conv").sortWithinPartitions(*_AT, F.desc("marks"), "seq", "part").mapInArrow(_fold, PIECE)


def _numbered(turns: DataFrame) -> DataFrame:
    """turns with the number of each among rows that are equal: 0 where a row has no equal, which keys of its hash tell without moving its text."""
    keys = ["conv", "seq", "print"]
    several = settled(turns.groupBy(*keys).agg(F.count("*").alias("same")).where("same > 1").drop("same"))
    if several.isEmpty():
        return turns.withColumn("row", F.lit(0).cast("bigint"))
    several = small(several, BROADCAST_ROWS)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    alone = turns.alias("a").join(several.alias("b"), same, "left_anti").withColumn("row", F.lit(0).cast("bigint"))
    # rows are equal, so one of each is counted, and told again as often, EQUAL at once
    again = turns.alias("a").join(several.alias("b"), same, "left_semi").groupBy(turns.columns).agg(F.count("*").alias("same"))
    again = again.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("same") - 1).cast("bigint"), F.lit(EQUAL))))
    return alone.union(again.select(*turns.columns, F.explode(F.sequence(F.col("k") + 1, F.least(F.col("k") + EQUAL, F.col("same")))).alias("row")))


def as_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of whole turns as the event log that a chat service might have kept of them.

    A turn is opened and streamed in deltas. By a hash of the turn, some answers
    have a draft before them, streamed in part and then regenerated, and some
    turns are opened with another text that an edit replaces. Turns of a
    conversation with the same number follow each other by a hash; repeated rows
    are turns of their own, told apart by their number among equal rows, so that
    a log read twice says the same whatever order its rows come in. Null texts
    are empty, null roles stay null, turns without a conversation form their own
    and those without a number come first in theirs. Texts of any length are
    streamed whole. Other columns aren't read; an empty table gives an empty log.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("seq"),
        F.col(f"`{role}`").alias("role"), body.alias("text"),
    )
    rows = _numbered(rows.withColumn("print", F.xxhash64("role", "text")))
    deltas = F.ceil(F.length("text") / DELTA_CHARS).cast("int")
    # the name orders turns alike in conversation and turn, and tells repeated rows apart
    rows = rows.withColumns({"name": F.lpad(F.hex(F.xxhash64("seq", "print", "row")), 16, "0"), "n": deltas, "luck": F.pmod(F.xxhash64("conv", "seq", "text"), F.lit(4))})

    def event(kind: str, final: bool, piece: Column | int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(final).alias("final"), (piece if isinstance(piece, Column) else F.lit(piece)).cast("int").alias("piece"))

    def streamed(first: int) -> Column:
        return F.when(F.col("n") > first, F.transform(F.sequence(F.lit(first), F.col("n") - 1), lambda i: event(DELTA, True, i))).otherwise(F.array().cast("array<struct<kind:string,final:boolean,piece:int>>"))

    empty, half, turned = -1, -2, -3
    plain = F.concat(F.array(event(OPEN, True, empty)), streamed(0))
    redone = F.concat(F.array(event(OPEN, False, empty), event(DELTA, False, half), event(REGENERATE, False, empty)), plain)
    edited = F.concat(F.array(event(OPEN, True, turned), event(EDIT, True, 0)), streamed(1))
    log = F.when((F.col("role") == "assistant") & (F.col("luck") == 0), redone).when(F.col("luck") == 1, edited).otherwise(plain)
    told = rows.select("*", F.posexplode(log).alias("part", "event"))
    piece = F.col("event.piece")
    said = F.when(piece >= 0, F.substring("text", piece * DELTA_CHARS + 1, F.lit(DELTA_CHARS))).when(piece == half, F.left("text", F.ceil(F.length("text") / 2).cast("int"))).when(piece == turned, F.reverse(F.left("text", F.lit(DELTA_CHARS)))).otherwise("")
    return told.select("conv", "seq", "part", F.col("event.kind").alias("kind"), F.concat("name", F.when(F.col("event.final"), "~1").otherwise("~0")).alias("message"), "role", said.alias("body"))


def store_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces written to a new Parquet table in the folder that executors share, to be read from there.

    pieces has the columns of PIECE; rows are stored as they are, null, empty,
    long and repeated ones too, in no order that read_back() relies on. Other
    columns would be written but not read. An empty table is stored as such.
    """
    path = f"{checkpoint_dir(pieces.sparkSession)}/chat-{uuid.uuid4().hex}"
    pieces.write.parquet(path)
    return pieces.sparkSession.read.schema(PIECE).parquet(path)


def _digests(batches):
    """Reads the pieces of each conversation back, in order, and hashes their turns and what the loss counts."""
    conv, state = object(), None
    out: list[tuple] = []

    def done():
        if state is not None:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for c, piece, mask in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv", "piece", "mask")), strict=True):
            if state is None or c != conv:
                done()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if mask:
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(piece)
        yield _rows(out)
        out = []
    done()
    yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation: what its formatted text says again when parsed, and what counts for the loss.

    pieces has the columns of PIECE, in any order and partitioning: they are
    brought together by conversation and sorted by place here, and a task holds
    one piece at a time. Pieces without a conversation form their own; a piece
    that repeats counts again; an empty table gives an empty result. Pieces are
    never null or empty, as render() puts marks around empty texts. Other columns
    aren't read.
    """
    placed = pieces.select("conv", "place", "piece", "mask").repartition("conv").sortWithinPartitions("conv", "place")
    return placed.mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _added(text: str) -> str:
    """SQL for how many characters escape() adds to a text: one for each backslash and for each place where a control string begins."""
    literals = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[/ANS]"]
    literals += [a + b + c for b in ("SYS", "ROLE") for a, c in (("<<", ""), ("<</", ""), ("<", ">"), ("</", ">"))]
    counts = [f"(length({text}) - length(replace({text}, '{x}', ''))) // {len(x)}" for x in literals]
    return " + ".join([*counts, f"len(regexp_extract_all({text}, '>')) - len(regexp_extract_all({text}, '>+'))"])


_SAID = "</s>[INST] ok [/INST]"
_MARKED = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
#: The query in DuckDB's SQL.
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
m AS (SELECT *, length(text) + {_added("text")} + CASE role {_MARKED} ELSE {sum(map(len, OTHER))} + length(role) + {_added("role")} END AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(formatted)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""
