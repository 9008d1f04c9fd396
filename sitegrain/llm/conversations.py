"""Repair of conversation structure (operator 13).

A conversation is put right by the cheapest edits of its turns that give the roles `(s?(ua)+)?`: K keeps a turn, R gives it
the role user or assistant (2), D deletes it (3), I inserts an empty turn (2); a turn that stays though it is cut off costs 1
more, blank and repeated turns must go. Of equally cheap edits those with the ASCII-least letters are taken.

The turns that stay form a subsequence. What lies between two of them is deleted, at the difference of two prefix sums, and the
roles of the two say how many turns to insert. So a row is priced against four running minima, one for each role that may come
before it (none, s, u, a), each less the deletions up to its own row. Letters break ties: the minima also hold their rank among
each other, so that two candidates are told apart by rank and last letters alone; deletions come before insertions, as D < I.

Rows are counted by (conv_id, turn, role, text) first, then dealt out by ranges of (conv_id, turn, role), so a long conversation
lies in many parts. A part prices a conversation that may go on in another part once for each of the four roles before it; a
conversation's parts are chained like small matrices. Only the digest of a conversation passes one task, as a stream,
since SHA-256 has no other order; it holds one text and the letters at a time.

Turns go by turn (null first), then role, then the MD5 of the text; rows that are equal follow each other. Defined cases: null
roles and texts are one space; a null conv_id is a conversation of its own; a conversation without rows keeps its
row with zeros, no letters and the digest of the empty string; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Characters that make no text, as rtrim and translate take them.
BLANKS = "\x20\t\n\x0b\x0c\r"
STOPS = ".!?"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits, and of a cut-off turn that stays.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
#: Turns to insert between the role before (rows) and a role (columns), None where it cannot follow; then at the end.
BETWEEN = ((None, 0, 0, 1), (None, None, 0, 1), (None, None, 1, 0), (None, None, 0, 1))
AT_END = (0, 2, 1, 0)

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string"
_EDIT = "struct<before:int,after:int,cost:long,audit:string>"
_SEGMENT = f"conv_id long, part int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, edits array<{_EDIT}>"


def damaged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with planted faults and `copies`; a dropped row has none."""
    tag = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text, kind = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("kind")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(tag) % 20).alias("kind"))
    stripped = F.translate("text", STOPS, "")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, stripped).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def counted(turns: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text) with copies and the text's key; rows without copies only tell that their conversation exists."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    gone = copies == 0
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(~gone, F.col("turn").cast("long")).alias("turn"), F.when(gone, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(gone, "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"), copies.cast("long").alias("copies"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", F.md5("text"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, copies, fault) of counted rows; fault is that of the first copy."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select("conv_id", "turn", "role", "key", "copies", (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(*STOPS)).alias("open"))
    again = rows.where("copies > 0").groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").alias("again")
    same = F.col("rows.conv_id").eqNullSafe(F.col("again.conv_id")) & (F.col("rows.role") == F.col("again.role")) & (F.col("rows.key") == F.col("again.key"))
    later = F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    return rows.alias("rows").join(again, same, "left").select("rows.conv_id", "turn", "rows.role", "rows.key", "copies", fault.alias("fault"))


def cheapest(initials: list[str], fault: list[int], copies: list[int], before: int) -> dict[int, tuple[int, str]]:
    """For each role that may come last, the cost and the letters of the cheapest edits of a run of rows after the role `before`."""
    minima: dict[int, tuple[int, int, tuple | None]] = {before: (0, 0, None)}  # cost less the deletions so far, rank, what stays
    deletions = at = 0
    for initial, wrong, n in zip(initials, fault, copies, strict=True):
        if wrong in (SOUND, TRUNCATED):
            ways = [(role, REROLE, "R") for role in (USER, ASSISTANT) if role != ROLES.get(initial)]
            if initial in ROLES:
                ways.append((ROLES[initial], 0, "K"))
            found = {role: (price, (rank, "D"), stays) for role, (price, rank, stays) in minima.items()}
            for role, own, letter in ways:
                own += CUT_OFF * (wrong == TRUNCATED) - DELETE  # what staying saves is one deletion
                for last, (price, rank, stays) in minima.items():
                    gap = BETWEEN[last][role]
                    if gap is not None:
                        new = (price + own + INSERT * gap, (rank, "I" * gap + letter), (at, gap, letter, stays))
                        if role not in found or new[:2] < found[role][:2]:
                            found[role] = new
            order = {x: i for i, x in enumerate(sorted(x[1] for x in found.values()))}
            minima = {role: (price, order[x], stays) for role, (price, x, stays) in found.items()}
        deletions += DELETE * n
        at += n
    return {role: (price + deletions, _letters(stays, at)) for role, (price, _, stays) in minima.items()}


def _letters(stays: tuple | None, total: int) -> str:
    kept = []
    while stays:
        *x, stays = stays
        kept.append(x)
    out, at = [], 0
    for place, gap, letter in reversed(kept):
        out.append("D" * (place - at) + "I" * gap + letter)
        at = place + 1
    return "".join(out) + "D" * (total - at)


def _segment(part: int, conv: int | None, rows: list[tuple], whole: bool) -> dict:
    """Counts and cheapest edits of a conversation's rows (turn, initial, copies, fault) in one part."""
    turns = sorted({r[0] for r in rows if r[0] is not None})
    initials, copies, fault = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
    pairs = sum(a + b not in LEGAL for a, b in pairwise(initials))
    again = sum(n if f == DUPLICATE else n - 1 if f != BLANK else 0 for n, f in zip(copies, fault, strict=True))
    out = {
        "conv_id": conv, "part": part, "blank": sum(n for n, f in zip(copies, fault, strict=True) if f == BLANK), "duplicate": again, "truncated": fault.count(TRUNCATED),
        "illegal": pairs + sum(copies) - len(rows), "turns": len(turns), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
    }
    edits = []
    for before in (NONE,) if whole else (NONE, SYSTEM, USER, ASSISTANT):
        edits += [{"before": before, "after": after, "cost": cost, "audit": audit} for after, (cost, audit) in cheapest(initials, fault, copies, before).items()]
    return out | {"edits": edits}


def _segments(schema: pa.Schema):
    """Task: sorted rows of a part to a segment for each conversation; the first and the last may go on in other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows, out, opened = TaskContext.get().partitionId(), None, [], [], 0
        for batch in batches:
            for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "copies", "fault")], strict=True):
                if not opened or conv != held:
                    if opened:
                        out.append(_segment(part, held, rows, opened > 1))
                    held, rows, opened = conv, [], opened + 1
                if row[2]:
                    rows.append(tuple(row))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if opened:
            out.append(_segment(part, held, rows, False))
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


class _Chain:
    """Segments of one conversation in order: its counts and its cheapest edits."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.turns, self.low, self.high, self.last = conv, [0] * 4, 0, None, None, None
        self.minima: dict[int, tuple[int, int, tuple | None]] = {NONE: (0, 0, None)}

    def add(self, s: dict) -> None:
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += s[name]
        if s["first"] is not None:
            self.counts[3] += self.last is not None and self.last + s["first"] not in LEGAL
            self.last = s["last"]
        if s["turns"]:
            self.turns += s["turns"] - (s["low"] == self.high)
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
        found: dict[int, tuple] = {}
        for e in s["edits"]:
            if e["before"] in self.minima:
                cost, rank, letters = self.minima[e["before"]]
                new = (cost + e["cost"], (rank, e["audit"]), (e["audit"], letters))
                if e["after"] not in found or new[:2] < found[e["after"]][:2]:
                    found[e["after"]] = new
        order = {x: i for i, x in enumerate(sorted(x[1] for x in found.values()))}
        self.minima = {role: (cost, order[x], letters) for role, (cost, x, letters) in found.items()}

    def close(self) -> tuple[int, str]:
        cost, _, role, letters = min((cost + INSERT * AT_END[role], rank, role, letters) for role, (cost, rank, letters) in self.minima.items())
        parts = ["I" * AT_END[role]]
        while letters:
            audit, letters = letters
            parts.append(audit)
        return cost, "".join(reversed(parts))


class _Replay:
    """Follows the letters over a conversation's rows; yields the turns of the repaired one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, NONE

    def _say(self, role: str, text: str) -> tuple[str, str]:
        self.last = ROLES[role[0]]
        return role, text

    def _next(self) -> str:
        return "assistant" if self.last == USER else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._say(self._next(), "")

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += copies
        if letter != "D":
            yield self._say(role if letter == "K" else self._next(), text)


def _finish(schema: pa.Schema, texts: bool):
    """Task: for each conversation its segments, then its rows, in order; to summaries or to the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = replay = sha = None
        out: list[dict] = []
        size = said = cost = 0

        def tell(turns: Iterator[tuple[str, str]]) -> int:
            nonlocal said
            n = 0
            for role, text in turns:
                if texts:
                    out.append({"conv_id": chain.conv, "place": said, "role": role, "text": text})
                    n += len(text)
                else:
                    sha.update(f"{chr(10) * (said > 0)}{role}:{text}".encode())
                said += 1
            return n

        def begin() -> None:
            nonlocal replay, sha, said, cost
            cost, audit = chain.close()
            replay, sha, said = _Replay(audit), hashlib.sha256(), 0

        def close() -> None:
            if replay is None:
                begin()
            tell(replay.inserted())
            if not texts:
                gaps = chain.high - chain.low + 1 - chain.turns if chain.turns else 0
                counts = dict(zip(("blank", "duplicate", "truncated", "illegal"), chain.counts, strict=True))
                out.append({"conv_id": chain.conv, "gaps": gaps, **counts, "cost": cost, "audit": replay.audit, "repaired_sha256": sha.hexdigest()})

        for batch in batches:
            for conv, role, text, copies, segment in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "segment")], strict=True):
                if chain is None or conv != chain.conv:
                    if chain is not None:
                        close()
                    chain, replay = _Chain(conv), None
                if segment is not None:
                    chain.add(segment)
                    continue
                if replay is None:
                    begin()
                size += tell(replay.row(role, text, copies))
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if chain is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def repair(spark: SparkSession, turns: DataFrame, texts: bool = False) -> DataFrame:
    """A row for each conversation of turns(conv_id, turn, role, text[, copies]), see SUMMARY; with `texts` the turns of the repaired ones."""
    scratch, parts = Scratch(spark, "conversations"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.save(counted(turns), "rows")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("key")]
    marked = faults(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = marked.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "copies", "fault")
    segments = marked.mapInArrow(_segments(_arrow(spark, _SEGMENT)), _SEGMENT)
    segments = scratch.save(segments.select("conv_id", "part", F.struct(*[c.split()[0] for c in _SEGMENT.split(", ")]).alias("segment")), "segments")
    both = rows.where("copies > 0").unionByName(segments, allowMissingColumns=True).repartition(parts, "conv_id")
    both = both.sortWithinPartitions(order[0], F.col("part").asc_nulls_last(), *order[1:]).select("conv_id", "role", "text", "copies", "segment")
    schema = TURNS if texts else SUMMARY
    return both.mapInArrow(_finish(_arrow(spark, schema), texts), schema)


def repair_table(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return repair(spark, damaged(turns))
