"""Operator 13: repair of conversation structure by an error-correcting Earley parser (earley.py).

Method:
1. Equal rows are counted before they are shuffled, so a repeated row travels once a task. Rows are then dealt by ranges of
   (conv_id, turn, role, text) and sorted, so a conversation of any length lies in one or more partitions in order.
2. A partition settles a conversation that it holds in whole and that has at most STRETCH rows: faults, the cheapest parse, and
   the repaired text. Parses are remembered by the row signs.
3. The rest, which is the first and last conversation of a partition and long ones, is dealt again by ranges. Whether a row
   stands earlier in its conversation is a minimum by conversation and row (two grouped aggregates, no window). Each partition
   parses its part in stretches from every place of the grammar and multiplies the results; the last step multiplies
   the parts of a conversation, takes the cheapest audit, and follows it along the rows to hash the repaired text. That step
   holds an audit, not the rows; an audit and a hash of a whole conversation are one value each.

Order within a conversation is turn (nulls first), role, text, both as bytes. A null role or text is one space, and a null
conv_id or turn is one in the name conv_id:turn that the damage hashes.

Defined results: blank rows and rows seen earlier in the conversation (same role and text) must go; a row's role counts by its
first letter, and one with another letter, or none, must get a role or go; texts of any length are read whole; rows that
repeat everything are duplicates; a null conv_id is a conversation; a conversation without rows has zeros, an empty audit and the
hash of nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .earley import PLACES, Product, Repair, cheapest, parse, table, then

SPACE = " \t\n\v\f\r"
STOPS = ".!?"
LEGAL = ("su", "ua", "au")
#: Rows of a conversation that a task holds, and of a stretch that is parsed at once.
STRETCH = 256
#: Stands for a null turn; it is the smallest.
NO_TURN = -(1 << 63)

ROWS_DDL = "conv_id long, at long, role string, text string, copies long"
ROWS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT_DDL = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
#: What a partition says of its part of a conversation (summary, in JSON) and, after it, the rows themselves.
PART_DDL = "conv_id long, part int, seq long, summary string, role string, text string, copies long, sign string"
PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("summary", pa.string()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("sign", pa.string())])


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with a fifth or so of them damaged, by crc32 of conv_id:turn modulo 20: 0 goes (copies 0, so that its conversation
    is still known), 1 loses its text, 2 its stops, 3 stands twice (copies), 4 becomes a user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    nothing = F.lit("")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(kind == 0, F.lit(None)).otherwise(F.col("turn").cast("long")).alias("turn"),
        F.when(kind == 0, nothing).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind < 2, nothing).when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def whole(conversations: DataFrame) -> DataFrame:
    """Undamaged rows in the form that repair() takes."""
    space = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).cast("long").alias("copies"))


def sign_of(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(Sign for the parser, fault: b, d, t or none) of a row."""
    bare = text.rstrip(SPACE)
    if not bare:
        return "x", "b"
    if seen:
        return "x", "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (initial, "") if bare[-1] in STOPS else (initial.upper(), "t")


class Tally:
    """Counts over rows in order; parts of a conversation add up."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, at: int, role: str, fault: str, copies: int) -> None:
        self.blank += copies if fault == "b" else 0
        self.duplicate += copies if fault == "d" else copies - 1 if fault != "b" else 0
        self.truncated += fault == "t"
        letter = role[:1]
        self.illegal += (self.last is not None and self.last + letter not in LEGAL) + copies - 1
        self.first = letter if self.first is None else self.first
        self.last = letter
        if at != NO_TURN:
            self.turns += at != self.high
            self.low = at if self.low is None else self.low
            self.high = at

    def join(self, other: Tally) -> None:
        """other comes after this one."""
        if other.first is None:
            return
        self.illegal += other.illegal + (self.last is not None and self.last + other.first not in LEGAL)
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.first, self.last = other.first if self.first is None else self.first, other.last
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high

    def counts(self) -> tuple[int, ...]:
        return (self.high - self.low + 1 - self.turns if self.turns else 0, self.blank, self.duplicate, self.truncated, self.illegal)


class Repaired:
    """Hash of the repaired text, and its pieces if they are wanted, as an audit is followed along the rows."""

    def __init__(self, audit: str, keep: bool = False):
        self.audit, self.at, self.state = audit, 0, Repair()
        self.hash, self.any = hashlib.sha256(), False
        self.pieces: list[str] | None = [] if keep else None

    def out(self, role: str, text: str) -> None:
        piece = f"{role}:{text}"
        self.hash.update((b"\n" if self.any else b"") + piece.encode())
        self.any = True
        if self.pieces is not None:
            self.pieces.append(piece)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.out(self.state.edit("I", ""), "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        """A row with its copies, of which all but the first must go."""
        self.inserts()
        if (given := self.state.edit(self.audit[self.at], role)) is not None:
            self.out(given, text)
        self.at += 1
        for _ in range(copies - 1):
            self.inserts()
            self.at += 1

    def done(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def settle(conv: int | None, rows: list[tuple[int, str, str, int]]) -> tuple:
    """The result of a conversation that is here in whole: rows of (at, role, text, copies) in order."""
    seen: set[tuple[str, str]] = set()
    tally, signs = Tally(), []
    for at, role, text, copies in rows:
        sign, fault = sign_of(role, text, (role, text) in seen)
        seen.add((role, text))
        tally.add(at, role, fault, copies)
        signs.append(sign + "x" * (copies - 1))
    cost, audit = cheapest(parse("".join(signs)))
    repaired = Repaired(audit)
    for _, role, text, copies in rows:
        repaired.row(role, text, copies)
    return (conv, *tally.counts(), cost, audit, repaired.done())


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def settled_here(stretch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by conversation: the results of whole short ones; rows of the others in `open`."""
    nothing = (0,) * len(COUNTS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held, long, first = None, [], 0, True

        def close() -> Iterator[tuple]:
            real = [(at, role, text, copies) for at, role, text, copies in held if copies]
            if long <= stretch:
                yield (*settle(now, real), None)

        def as_open(conv: int | None, row: tuple) -> tuple:
            return (conv, *nothing, None, None, dict(zip(("at", "role", "text", "copies"), row, strict=True)))

        empty = True
        for conv, *row in rows_of(batches):
            row = tuple(row)
            if empty or conv != now:
                if not empty and not first:
                    yield from close()
                if not empty:
                    first = False
                now, held, long, empty = conv, [], 0, False
            long += row[3]
            if first or long > stretch:
                yield from (as_open(conv, r) for r in [*held, row])
                held = []
            else:
                held.append(row)
        yield from (as_open(now, r) for r in held)

    kind = pa.struct([(f.name, f.type) for f in list(ROWS)[1:]])
    schema = RESULT.append(pa.field("open", kind))
    return lambda batches: common.batches_of(rows(batches), schema)


SETTLED_DDL = RESULT_DDL + ", open struct<at:long, role:string, text:string, copies:long>"


def parts_of(stretch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows with `seen`, sorted by conversation: the rows with their signs, then a summary of the part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        now, empty, seq, product, signs, tally = None, True, 0, Product(), "", Tally()

        def summary() -> tuple:
            if signs:
                product.put(table(signs))
            return now, part, -1, json.dumps([product.total(), vars(tally)]), None, None, None, None

        for conv, at, role, text, copies, seen in rows_of(batches):
            if empty or conv != now:
                if not empty:
                    yield summary()
                now, empty, seq, product, signs, tally = conv, False, 0, Product(), "", Tally()
            if not copies:
                continue
            sign, fault = sign_of(role, text, seen)
            tally.add(at, role, fault, copies)
            yield conv, part, seq, None, role, text, copies, sign
            seq += 1
            signs += sign
            left = copies - 1
            while left or len(signs) >= stretch:
                more = min(left, stretch - len(signs))
                signs, left = signs + "x" * more, left - more
                if len(signs) >= stretch:
                    product.put(table(signs))
                    signs = ""
        if not empty:
            yield summary()

    return lambda batches: common.batches_of(rows(batches), PART)


def joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For parts sorted by conversation, summaries first: the results."""

    def rows() -> Iterator[tuple]:
        now, empty, tally, ends, repaired, found = None, True, Tally(), {}, None, ()

        def begin_rows() -> None:
            nonlocal repaired, found
            cost, audit = cheapest(ends)
            found = (now, *tally.counts(), cost, audit)
            repaired = Repaired(audit)

        def close() -> tuple:
            if repaired is None:
                begin_rows()
            return (*found, repaired.done())

        for conv, _, _, summary, role, text, copies, _ in rows_of(batches):
            if empty or conv != now:
                if not empty:
                    yield close()
                now, empty, tally, ends, repaired = conv, False, Tally(), {"B": (0, "")}, None
            if summary is not None:
                stretch, counts = json.loads(summary)
                other = Tally()
                vars(other).update(counts)
                tally.join(other)
                ends = then(ends, {p: {q: tuple(w) for q, w in stretch[p].items()} for p in PLACES})
            else:
                if repaired is None:
                    begin_rows()
                repaired.row(role, text, copies)
        if not empty:
            yield close()

    yield from common.batches_of(rows(), RESULT)


KEY = ("conv_id", "at", "role", "text")


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)


def seen_earlier(rows: DataFrame) -> DataFrame:
    """rows with `seen`: whether the conversation has the role and text at an earlier turn."""
    key: Column = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    keyed = rows.withColumn("key", key)
    firsts = keyed.where("copies > 0").groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    joined = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    return joined.select(*ROWS.names, (F.col("at") > F.coalesce("first", "at")).alias("seen"))


def repair(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """rows: conv_id, turn, role, text, copies (0: only names the conversation). Faults, cost, audit and hash of each
    conversation."""
    spark = rows.sparkSession
    parts = common.shuffle_partitions(spark)
    common.short_batches(spark)
    counted = rows.select("conv_id", F.coalesce("turn", F.lit(NO_TURN)).alias("at"), "role", "text", "copies").groupBy(*KEY).agg(F.sum("copies").alias("copies"))
    first = common.materialize(in_order(counted, parts).mapInArrow(settled_here(stretch), SETTLED_DDL), "conversations")
    rest = first.where("open IS NOT NULL").select("conv_id", "open.*")
    summed = in_order(seen_earlier(rest), parts).mapInArrow(parts_of(stretch), PART_DDL)
    last = summed.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("summary").isNull(), "part", "seq").mapInArrow(joined_parts, RESULT_DDL)
    return first.where("open IS NULL").select(*RESULT.names).union(last)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of `conversations`, damaged."""
    return repair(damage(common.table(spark, sf_dir, "conversations")))


#: Steps of one row from place p to q: sign of the row's role (* for any), edits, cost, role inserted before, role given (= keeps).
ORACLE_SQL = r"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM conversations),
coded AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS k FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE k <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM ordered),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM judged),
steps(p, sign, edits, q, cost, before, gives) AS (VALUES ('B', 's', 'K', 'S', 0, NULL, '='),
  ('B', 'u', 'K', 'U', 0, NULL, '='), ('S', 'u', 'K', 'U', 0, NULL, '='), ('A', 'u', 'K', 'U', 0, NULL, '='), ('U', 'a', 'K', 'A', 0, NULL, '='),
  ('B', 'a', 'IK', 'A', 2, 'user', '='), ('S', 'a', 'IK', 'A', 2, 'user', '='), ('A', 'a', 'IK', 'A', 2, 'user', '='), ('U', 'u', 'IK', 'U', 2, 'assistant', '='),
  ('B', '*', 'R', 'U', 2, NULL, 'user'), ('S', '*', 'R', 'U', 2, NULL, 'user'), ('A', '*', 'R', 'U', 2, NULL, 'user'), ('U', '*', 'R', 'A', 2, NULL, 'assistant'),
  ('B', '*', 'IR', 'A', 4, 'user', 'assistant'), ('S', '*', 'IR', 'A', 4, 'user', 'assistant'), ('A', '*', 'IR', 'A', 4, 'user', 'assistant'), ('U', '*', 'IR', 'U', 4, 'assistant', 'user'),
  ('B', 'D', 'D', 'B', 3, NULL, NULL), ('S', 'D', 'D', 'S', 3, NULL, NULL), ('U', 'D', 'D', 'U', 3, NULL, NULL), ('A', 'D', 'D', 'A', 3, NULL, NULL)),
parses AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 'B' AS p, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS pieces FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, p, cost, audit, pieces FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, p ORDER BY cost, audit) AS k FROM (
    SELECT parses.conv_id, faults.i, q AS p, parses.cost + steps.cost + CASE WHEN fault = 't' AND gives IS NOT NULL THEN 1 ELSE 0 END AS cost, audit || edits AS audit,
      list_concat(pieces, CASE WHEN before IS NULL THEN CAST([] AS VARCHAR[]) ELSE [before || ':'] END, CASE WHEN gives IS NULL THEN CAST([] AS VARCHAR[]) ELSE [CASE gives WHEN '=' THEN role ELSE gives END || ':' || text] END) AS pieces
    FROM parses JOIN faults ON faults.conv_id IS NOT DISTINCT FROM parses.conv_id AND faults.i = parses.i + 1
      JOIN steps ON steps.p = parses.p AND (sign = 'D' OR (fault IN ('', 't') AND (sign = '*' OR sign = left(role, 1)))))) WHERE k = 1),
finished AS (SELECT conv_id, i, cost + CASE p WHEN 'U' THEN 2 WHEN 'S' THEN 4 ELSE 0 END AS cost, audit || CASE p WHEN 'U' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END AS audit,
  list_concat(pieces, CASE p WHEN 'U' THEN ['assistant:'] WHEN 'S' THEN ['user:', 'assistant:'] ELSE CAST([] AS VARCHAR[]) END) AS pieces FROM parses),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC, cost, audit) AS k FROM finished),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(pieces, chr(10))) AS repaired_sha256
FROM best LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM best.conv_id WHERE k = 1
"""
