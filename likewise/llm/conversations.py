"""Conversations whose turns are put in order by the cheapest edits.

Every row of a conversation is kept, given another role or deleted, and empty turns may be put in,
so that the roles' initials read ``(s?(ua)+)?``. The cheapest way is found by one shortest-path
program over (row, what the last turn was), in which a path's weight is a single whole number: its
high digits are the cost, its low digits the letters of its edits, the first letter in the highest
place, of a fixed width, filled up with zeros. The least number is the lowest cost and, among
equal costs, the edits that come first in ASCII order. Long conversations are weighed in stretches:
the digit that closes a stretch says which of the ways on from there comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likewise.sources.staging import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What an unfinished row costs unless it is deleted.
TRUNCATED = 1

_SPACE = " \t\n\x0b\x0c\r"
_FINE, _BLANK, _DUPLICATE, _CUT = range(4)

# What the last turn was: none yet, system, user, assistant.
_NONE, _S, _U, _A = range(4)
#: The turn that a row of a role may be after each of them.
_ROLES = {"s": {_NONE: _S}, "u": {_NONE: _U, _S: _U, _A: _U}, "a": {_U: _A}}
#: The turn that is due after each of them.
_DUE = {_NONE: _U, _S: _U, _A: _U, _U: _A}
_DUE_ROLE = {_U: "user", _A: "assistant"}
_DIGIT = {x: n for n, x in enumerate(sorted(COST), 1)}
_LETTER = {n: x for x, n in _DIGIT.items()}
_BITS = 3


def _ways(initial: str, fault: int) -> list[list[tuple[int, int, int]]]:
    """For every last turn, the (letter's digit, cost, turn after) of what can be done with a row."""
    extra = TRUNCATED if fault == _CUT else 0
    ways = []
    for last in range(4):
        own = [(_DIGIT[DELETE], COST[DELETE], last)]
        if fault not in (_BLANK, _DUPLICATE):
            after = _ROLES.get(initial, {}).get(last)
            if after is not None:
                own.append((_DIGIT[KEEP], COST[KEEP] + extra, after))
            own.append((_DIGIT[REROLE], COST[REROLE] + extra, _DUE[last]))
        ways.append(own)
    return ways


#: By code, a row's initial and fault in one byte.
_INITIALS = "sua?"
_CODES = {"s": 0, "u": 1, "a": 2}
_WAYS = [_ways(_INITIALS[code >> 2], code & 3) for code in range(16)]


def cheapest(codes: bytes, stretch: int = 128) -> tuple[int, str]:
    """The least cost, and the letters of its edits, for the rows of a conversation."""
    width = 3 * stretch + 1  # two turns put in before each row, the row, the closing digit
    low = _BITS * width
    mask, top = (1 << low) - 1, low - _BITS

    def led(digit: int, cost: int, rest: int) -> int:
        """The weight of a path with one more edit at its beginning."""
        return ((rest >> low) + cost << low) | digit << top | (rest & mask) >> _BITS

    insert, costs = _DIGIT[INSERT], COST[INSERT]
    # What is left to do after the last row: nothing, or the turns of the begun pair.
    tail = ["", "II", "I", ""]
    spent = [costs * len(x) for x in tail]
    stretches: list[tuple[list[str], list[int]]] = []
    order = sorted(range(4), key=lambda q: tail[q])
    end = len(codes)
    while end:
        begin = max(0, end - stretch)
        weight = [spent[q] << low | order.index(q) + 1 << top for q in range(4)]
        for code in reversed(codes[begin:end]):
            ways = _WAYS[code]
            row = [min(led(d, c, weight[q]) for d, c, q in own) for own in ways]
            weight = []
            for last in range(4):
                one = _DUE[last]
                once = led(insert, costs, row[one])
                twice = led(insert, costs, led(insert, costs, row[_DUE[one]]))
                weight.append(min(row[last], once, twice))
        letters, exits = [], []
        for w in weight:
            digits = w & mask
            read = []
            for place in range(width - 1, -1, -1):
                digit = digits >> _BITS * place & 7
                if not digit:
                    break
                read.append(digit)
            exits.append(order[read.pop() - 1])
            letters.append("".join(_LETTER[d] for d in read))
        stretches.append((letters, exits))
        spent = [w >> low for w in weight]
        order = sorted(range(4), key=lambda q: weight[q] & mask)
        end = begin
    now, audit = _NONE, []
    for letters, exits in reversed(stretches):
        audit.append(letters[now])
        now = exits[now]
    return spent[_NONE], "".join(audit) + tail[now]


@dataclass
class _Seen:
    """What is known of a conversation whose rows come in order."""

    codes: bytearray = field(default_factory=bytearray)
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    low: int | None = None
    high: int | None = None
    turns: int = 0
    illegal: int = 0
    before: str | None = None

    def add(self, turn: int | None, initial: str, fault: int, first: bool, n: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        again = fault if fault == _BLANK else _DUPLICATE
        code = _CODES.get(initial, 3) << 2
        for k in range(n):
            own = again if k or not first else fault
            self.faults[own] += 1
            self.codes.append(code | own)
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial

    def row(self, conversation: object) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = cheapest(bytes(self.codes))
        return (conversation, gaps, *self.faults[1:], self.illegal, cost, audit)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _like(df: DataFrame, column: str, rest: str) -> T.StructType:
    """A schema of this column, nullable, and of more columns."""
    more = df.sparkSession.createDataFrame([], rest).schema
    return T.StructType([T.StructField(column, df.schema[column].dataType), *more.fields])


def _arrow(df: DataFrame) -> pa.Schema:
    """The Arrow schema of the table's rows."""
    return df.limit(0).toArrow().schema


def rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with nulls of role and text as one space; nothing else."""
    space = F.lit(" ")
    return turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    )


def _digest() -> Column:
    return F.md5("text")


#: Spark sorts nulls first.
_ORDER = ["conv_id", "turn", "role"]


def plan(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation.

    ``turns`` has conv_id, turn, role and text; other columns are not looked at. Rows follow each
    other by turn, nulls first, rows of the same turn by role and a digest of the text, so equal
    rows stand together. A null role or text is one space, a null conv_id a conversation like any
    other. Every row's first fault counts: blank, a role and text seen before in its conversation,
    or an end other than ``.``, ``!`` or ``?``. Blank and repeated rows have to be deleted. Very
    long texts are only looked at where they lie, a digest of theirs travels. A conversation of
    very many turns takes a few bytes of memory per turn; equal rows are counted before they are
    shuffled. An empty table gives no rows.
    """
    stripped = F.rtrim("text", F.lit(_SPACE))
    end = F.substring(stripped, -1, 1)
    fault = F.when(end == "", _BLANK).when(end.isin(".", "!", "?"), _FINE).otherwise(_CUT)
    equal = (
        rows(turns)
        .select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"))
        .groupBy("conv_id", "turn", "role", "digest", "fault")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Equal rows of a turn are one row by now, so only a text said in very many turns is a long group.
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    marked = equal.withColumn("first", F.row_number().over(same) == 1)
    sorted_rows = (
        marked.repartition("conv_id")
        .sortWithinPartitions(*_ORDER, "digest")
        .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "first", "n")
    )
    schema = _like(turns, "conv_id", ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")
    arrow = _arrow(turns.sparkSession.createDataFrame([], schema))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[object, _Seen] | None = None
        for batch in batches:
            done = []
            columns = (batch.column(i).to_pylist() for i in range(6))
            for conversation, turn, initial, fault, first, n in zip(*columns, strict=True):
                if now is None or now[0] != conversation:
                    if now is not None:
                        done.append(now[1].row(now[0]))
                    now = (conversation, _Seen())
                now[1].add(turn, initial, fault, first, n)
            yield _batch(done, arrow)
        if now is not None:
            yield _batch([now[1].row(now[0])], arrow)

    return sorted_rows.mapInArrow(planned, schema)


def _batch(of: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*of, strict=True)) or [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class _Edits:
    """The edits of one conversation, carried out as its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.place = audit, 0, _NONE, 0

    def _put(self, turn: int) -> int:
        self.last = turn
        self.place += 1
        return self.place - 1

    def inserted(self) -> Iterator[tuple[int, str, str, str]]:
        """The empty turns that come next: (place, role, text, edit)."""
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            due = _DUE[self.last]
            yield self._put(due), _DUE_ROLE[due], "", INSERT

    def take(self, role: str, text: str) -> tuple[int, str, str, str] | None:
        """What becomes of the next row."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == DELETE:
            return None
        if edit == KEEP:
            return self._put(_ROLES[role[:1]][self.last]), role, text, edit
        due = _DUE[self.last]
        return self._put(due), _DUE_ROLE[due], text, edit


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit: the turns after the edits, in order within partitions.

    ``plans`` is what ``plan`` gives for the same ``turns``. The edits travel to the turns, and
    the turns pass by them: no task holds more of a conversation than a batch of its rows.
    """
    none = F.lit(None)
    edits = plans.select(
        "conv_id",
        none.cast("bigint").alias("turn"),
        none.cast("string").alias("role"),
        F.col("audit").alias("text"),
        none.cast("string").alias("digest"),
    )
    both = edits.unionByName(rows(turns).withColumn("digest", _digest()))
    passing = (
        both.repartition("conv_id")
        # A null digest marks the edits, which come before the rows.
        .withColumn("is_row", F.col("digest").isNotNull())
        .sortWithinPartitions("conv_id", "is_row", *_ORDER[1:], "digest")
        .select("conv_id", "is_row", "role", "text")
    )
    schema = _like(turns, "conv_id", "place long, role string, text string, edit string")
    arrow = _arrow(turns.sparkSession.createDataFrame([], schema))

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[object, _Edits] | None = None
        for batch in batches:
            made: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for conversation, is_row, role, text in zip(*columns, strict=True):
                if not is_row:
                    if now is not None:
                        made += [(now[0], *x) for x in now[1].inserted()]
                    now = (conversation, _Edits(text))
                    continue
                made += [(conversation, *x) for x in now[1].inserted()]
                taken = now[1].take(role, text)
                if taken is not None:
                    made.append((conversation, *taken))
            yield _batch(made, arrow)
        if now is not None:
            yield _batch([(now[0], *x) for x in now[1].inserted()], arrow)

    return passing.mapInArrow(edited, schema)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the turns as ``role:text``, one a line; for ``repaired`` as it comes."""
    schema = _like(turns, "conv_id", "sha256 string")
    arrow = _arrow(turns.sparkSession.createDataFrame([], schema))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for conversation, role, text in zip(*columns, strict=True):
                line = f"{role}:{text}".encode()
                if now is None or now[0] != conversation:
                    if now is not None:
                        done.append((now[0], now[1].hexdigest()))
                    now = (conversation, hashlib.sha256(line))
                else:
                    now[1].update(b"\n" + line)
            yield _batch(done, arrow)
        if now is not None:
            yield _batch([(now[0], now[1].hexdigest())], arrow)

    return turns.select("conv_id", "role", "text").mapInArrow(hashed, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with the faults that a hash of ``conv_id:turn`` deals out.

    Of twenty equally likely values, 0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and
    ``?`` out of it, 3 repeats the row, 4 gives it to the user. Nulls are one space.
    """
    space = F.lit(" ")
    of = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    dealt = rows(turns).withColumn("fault", F.crc32(F.concat(of[0], F.lit(":"), of[1])) % 20)
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return (
        dealt.where("fault != 0")
        .withColumn("text", text)
        .withColumn("role", F.when(fault == 4, "user").otherwise(F.col("role")))
        .select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"))
        .drop("copy")
    )


def repair_report(original: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: the plan for its ``turns`` and repaired_sha256.

    A conversation without turns has zeros, no edits and the hash of the empty text.
    """
    plans = stage(plan(turns), "repair-plans")
    hashes = digests(repaired(turns, plans)).withColumnRenamed("conv_id", "_hashed")
    ids = original.select("conv_id").distinct()
    known = plans.withColumnRenamed("conv_id", "_planned")
    zero = F.lit(0).cast("bigint")
    return (
        ids.join(known, F.col("conv_id").eqNullSafe(F.col("_planned")), "left")
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, zero).alias(c) for c in _COUNTS],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )
