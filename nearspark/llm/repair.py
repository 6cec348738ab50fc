"""Conversation repair as lightest derivations, found by Knuth's agenda.

A repair of a conversation is a derivation of its rows, in order, into a list of
messages whose role initials match ``(s?(ua)+)?``. Items are ``(rows read, state)``;
edits are the hyperedges, each with a cost and a letter of the audit trail:

======  ====  ==================================================================
letter  cost  edit
======  ====  ==================================================================
D       4     delete the row (the only edit of a blank or repeated row)
I       3     insert an empty message of the role that the state asks for
K       0     keep the row, if the state allows its role
R       3     keep the row's text under the role that the state asks for
======  ====  ==================================================================

A truncated row that is kept or re-roled costs 3 more. The value of an item is
``(cost, audit)``, compared in that order, audits by their ASCII codes. Every edit
adds no negative cost and makes the audit longer, so values only grow along a
derivation (superior functions): the agenda pops items lightest first, an item is
final when it is first popped, and the search ends when the goal is. Two equal
costs of one item never have an audit that begins with the other (it would have
more inserts, which cost), so appending edits keeps their order.

A conversation of more than ``SPAN`` rows is derived in spans: an item
``(span, from, to)`` for each pair of states, and neighbouring spans joined by
hyperedges of two premises in a balanced order.

States: 0 nothing yet, 1 after the system message, 2 after a user, 3 after an
assistant message; goals are 0 and 3 behind the last row. Only initials decide
about a kept role.

On Spark, the rows of a conversation meet by one shuffle, sorted, and pass one
task as a stream that holds about 40 bytes a row and no text; texts follow in a
second stream, led by the conversation's audit. Nothing else is gathered, so a
conversation's length is bounded by what its audit, a value of the result, may be.

Odd rows: a null role or text counts as one space, also in the key of ``damage``;
rows with a null id form one conversation; a null turn comes first; rows of equal
turn are ordered by role and text. Empty and very long texts need no rule of their
own. Repeated rows are rows, and their later copies duplicates. An empty table
gives an empty result; columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

SPAN = 256
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: state -> {initial of a role that may follow: next state}
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: state -> (role that an insert or a new role gives, next state)
ASKED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
GOALS = (0, 3)

BLANK, DUPLICATE, TRUNCATED, SOUND = 1, 2, 3, 0


def _steps(rows: list[tuple[str, int]], i: int, q: int):
    """Hyperedges out of item ``(i, q)``: ``(cost, letter, next item)``."""
    yield INSERT, "I", (i, ASKED[q][1])
    if i < len(rows):
        initial, fault = rows[i]
        yield DELETE, "D", (i + 1, q)
        if fault not in (BLANK, DUPLICATE):
            more = CUT_OFF if fault == TRUNCATED else 0
            if initial in FOLLOWS[q]:
                yield more, "K", (i + 1, FOLLOWS[q][initial])
            yield REROLE + more, "R", (i + 1, ASKED[q][1])


def lightest(rows: list[tuple[str, int]], start: int = 0, goals: tuple[int, ...] = GOALS,
             first_goal_only: bool = True) -> dict[int, tuple[int, str]]:
    """Final values of the goal states behind the last of ``rows`` (initial, fault), from state ``start``."""
    agenda: list[tuple[int, str, tuple[int, int]]] = [(0, "", (0, start))]
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final.add(item)
        i, q = item
        if i == len(rows) and q in goals:
            found[q] = (cost, audit)
            if first_goal_only or len(found) == len(goals):
                break
        for more, letter, to in _steps(rows, i, q):
            if to not in final:
                heapq.heappush(agenda, (cost + more, audit + letter, to))
    return found


def _span(rows: list[tuple[str, int]]) -> dict[tuple[int, int], tuple[int, str]]:
    return {(p, q): v for p in range(4) for q, v in lightest(rows, p, (0, 1, 2, 3), False).items()}


def _join(left: dict, right: dict) -> dict:
    """Span items over both spans: hyperedges with one premise of each side."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for (p, r), (c1, a1) in left.items():
        for q in range(4):
            if (r, q) in right:
                c2, a2 = right[r, q]
                if (p, q) not in out or (c1 + c2, a1 + a2) < out[p, q]:
                    out[p, q] = (c1 + c2, a1 + a2)
    return out


class Derivation:
    """Lightest repair of a conversation whose rows come one by one."""

    def __init__(self, span: int = SPAN):
        self.span, self.rows = span, []
        self.spans: list[tuple[int, dict]] = []  # sizes fall, as in a binary counter

    def add(self, initial: str, fault: int) -> None:
        self.rows.append((initial, fault))
        if len(self.rows) == self.span:
            size, item = 1, _span(self.rows)
            self.rows = []
            while self.spans and self.spans[-1][0] == size:
                item = _join(self.spans.pop()[1], item)
                size *= 2
            self.spans.append((size, item))

    def result(self) -> tuple[int, str]:
        if not self.spans:
            return min(lightest(self.rows).values())
        item = _span(self.rows)
        for _, left in reversed(self.spans):
            item = _join(left, item)
        return min(item[0, q] for q in GOALS if (0, q) in item)


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults planted by the checksum of ``conv_id:turn``."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)], F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = _prepared(rows, conv, turn, role, text).withColumn("_k", F.crc32(key) % 20).filter("_k <> 0")
    spoilt = (F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", ""))
              .otherwise(F.col("text")))
    d = d.select("conv_id", "turn", F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                 spoilt.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))))
    return d.select("conv_id", "turn", "role", "text")


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    """Rows of a conversation together, in order (ascending puts nulls first)."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, "turn", "role", "text")


def _flags() -> tuple[Column, Column]:
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    return shown == "", ~F.substring(shown, -1, 1).isin(".", "!", "?")


def _groups(batches, columns):
    """``(conv_id, row index from 0, values)`` of each row, conversations in a row."""
    last, n = object(), 0
    for batch in batches:
        for values in zip(*[batch.column(c).to_pylist() for c in columns]):
            n = n + 1 if values[0] == last else 0
            last = values[0]
            yield n, values


class _Out:
    """Collects result rows into batches bounded by rows and bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 4000, n_bytes: int = 4 << 20):
        self.schema, self.most, self.n_bytes = schema, rows, n_bytes
        self.rows, self.held = [], 0

    def add(self, row: tuple, size: int):
        self.rows.append(row)
        self.held += size
        if len(self.rows) >= self.most or self.held >= self.n_bytes:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)],
                                          schema=self.schema)


def _derive(schema: pa.Schema, span: int):
    def run(batches):
        out, state = _Out(schema), None
        for n, (conv, turn, initial, key, blank, cut) in _groups(
                batches, ("conv_id", "turn", "initial", "key", "blank", "cut")):
            if n == 0:
                if state:
                    yield from out.add(*state.row())
                state = _Audit(conv, span)
            state.add(turn, initial, key, blank, cut)
        if state:
            yield from out.add(*state.row())
        yield out.flush()
    return run


class _Audit:
    """Counts and lightest repair of one conversation."""

    def __init__(self, conv, span: int):
        self.conv, self.derivation, self.seen, self.last = conv, Derivation(span), set(), None
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn, initial: str, key: bytes, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:  # rows come by turn
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        fault = BLANK if blank else DUPLICATE if key in self.seen else TRUNCATED if cut else SOUND
        self.seen.add(key)
        self.faults[fault] += 1
        self.derivation.add(initial, fault)

    def row(self) -> tuple[tuple, int]:
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns
        cost, audit = self.derivation.result()
        return (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
                cost, audit), len(audit) + 80


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Per conversation of ``(conv_id, turn, role, text)``: fault counts, cost and audit of its lightest repair."""
    blank, cut = _flags()
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    kind = rows.schema["conv_id"].dataType
    schema = ST.StructType([ST.StructField("conv_id", kind), *[ST.StructField(c, ST.LongType()) for c in _LONGS],
                            ST.StructField("audit", ST.StringType())])
    slim = _in_order(rows).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), key.alias("key"),
                                  blank.alias("blank"), cut.alias("cut"))
    return slim.mapInArrow(_derive(_arrow(schema), span), schema)


def _arrow(schema: ST.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _apply(schema: pa.Schema):
    def run(batches):
        out, audit, at, q, place = _Out(schema), "", 0, 0, 0

        def inserts():
            nonlocal at, q, place
            while at < len(audit) and audit[at] == "I":
                role, q = ASKED[q]
                yield from out.add((conv, place, role, ""), 20)
                at, place = at + 1, place + 1

        for n, (conv, first, role, text) in _groups(batches, ("conv_id", "first", "role", "text")):
            if first == 0:
                audit, at, q, place = text, 0, 0, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    role, q = (role, FOLLOWS[q][role[:1]]) if edit == "K" else ASKED[q]
                    yield from out.add((conv, place, role, text), len(text) + 20)
                    place += 1
            yield from inserts()
        yield out.flush()
    return run


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Messages ``(conv_id, place, role, text)`` of every repaired conversation.

    ``found`` is ``audits(rows)``. The messages of a conversation are in one
    partition, in order.
    """
    led = (found.select("conv_id", F.lit(0).alias("first"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                        F.lit("").alias("role"), F.col("audit").alias("text"))
           .unionByName(rows.select("conv_id", F.lit(1).alias("first"), "turn", "role", "text")))
    kind = rows.schema["conv_id"].dataType
    schema = ST.StructType([ST.StructField("conv_id", kind), ST.StructField("place", ST.LongType()),
                            ST.StructField("role", ST.StringType()), ST.StructField("text", ST.StringType())])
    return _in_order(led, "first").mapInArrow(_apply(_arrow(schema)), schema)


def _digest(schema: pa.Schema):
    def run(batches):
        out, last, sha = _Out(schema), None, None
        for n, (conv, role, text) in _groups(batches, ("conv_id", "role", "text")):
            if n == 0:
                if sha:
                    yield from out.add((last, sha.hexdigest()), 80)
                last, sha = conv, hashlib.sha256()
            sha.update((f"\n{role}:{text}" if n else f"{role}:{text}").encode())
        if sha:
            yield from out.add((last, sha.hexdigest()), 80)
        yield out.flush()
    return run


def digests(messages: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; ``messages`` as from ``repaired``."""
    schema = ST.StructType([messages.schema["conv_id"], ST.StructField("repaired_sha256", ST.StringType())])
    return messages.select("conv_id", "role", "text").mapInArrow(_digest(_arrow(schema)), schema)


def repair_report(original: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """Damage every conversation of ``original``, repair it and report; one row per conversation."""
    rows = damage(original, conv, turn, role, text)
    found = audits(rows)
    shas = digests(repaired(rows, found)).withColumnRenamed("conv_id", "_c")
    every = original.select(F.col(conv).alias("_o")).distinct()
    out = (every.join(found, F.col("_o").eqNullSafe(F.col("conv_id")), "left")
           .join(shas, F.col("_o").eqNullSafe(F.col("_c")), "left"))
    return out.select(F.col("_o").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _LONGS],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
