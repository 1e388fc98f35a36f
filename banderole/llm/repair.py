"""Conversation structure repair at the least cost.

A conversation's rows are edited until the initials of its roles read ``(s?(ua)+)?``: Keep costs
0, Rerole to user or assistant 1, Delete 2 (required for blank rows and for duplicates), Insert of an empty user or
assistant turn 5; a row that stays and is cut off adds 5.  Among the cheapest edits the one whose
initials, in order, are ASCII-least is taken.

Method: backward cost-to-go over (turn, grammar state), then a greedy forward walk that takes the ASCII-least edit among the
transitions that the cost-to-go shows to be tight, and rebuilds the turns.  The state fixes the role that the next
turn must have, so the initials alone determine the repaired conversation.  The grammar's states: 0 nothing yet, 1 after the
system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.

A conversation may hold any share of all turns.  Identical rows are counted before any shuffle and
stay one row; all but the first of them are deleted.  Rows are range-partitioned by
(conversation, turn, role, start of the text), so a long conversation is many consecutive chunks on many tasks.  A chunk gives a
4 x 4 table: the cost from each state before it to each after it.  These tables, composed from the last
chunk to the first, give the cost-to-go at every border.  Only the walk itself, a chain like the
digest that it feeds, passes over a conversation in one task, one chunk in memory at a time (and 16 numbers for each chunk).

Faults, the first that holds: blank (no character outside ``\\x20\\x09-\\x0D``), duplicate (role and text
seen earlier), truncated (the last such character is none of ``.!?``).

Edge cases: a null role or text is one space (so a null text is blank, a null role must be changed); null
turns come first and don't count as gaps; equal turns go by role, then text; a null conversation is a conversation of its own; no rows
give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import quoted, short_keys
from .store import materialise, shuffle_partitions

# What edits cost.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5

NEVER = 1 << 60
Costs = tuple[int, int, int, int]
END: Costs = (0, INSERT + INSERT, INSERT, 0)

#: The state after a turn of the role that the grammar wants next, and that role.
NEXT = (2, 2, 3, 2)
WANTED = ("user", "user", "assistant", "user")

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")

CHUNK_ROWS, CHUNK_BYTES = 1024, 1 << 20


def fault(text: str, duplicate: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    last = _LAST.search(text)
    if last is None:
        return "blank"
    if duplicate:
        return "duplicate"
    return "" if last[0] in ".!?" else "truncated"


def _kept(role: str, state: int) -> int | None:
    """The state after keeping a turn as it is, if the grammar allows it."""
    first = role[:1]
    if first == "s" and state == 0:
        return 1
    return NEXT[state] if first and first == WANTED[state][0] else None


def before(role: str, kind: str, times: int, after: Costs) -> Costs:
    """Cost-to-go before ``times`` identical rows from that after them."""
    extra = times if kind in ("blank", "duplicate") else times - 1
    add = CUT_OFF if kind == "truncated" else 0
    out = []
    for s in range(4):
        if kind in ("blank", "duplicate"):
            least = after[s]
        else:
            least = min(DELETE + after[s], REROLE + add + after[NEXT[s]])
            to = _kept(role, s)
            if to is not None:
                least = min(least, KEEP + add + after[to])
        out.append(least + DELETE * extra)
    two, three = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return min(out[0], INSERT + two), min(out[1], INSERT + two), two, three


def cost_to_go(rows: list[tuple[str, str, int]], end: Costs) -> list[Costs]:
    """Before every row of (role, fault, times), and ``end`` after the last."""
    out = [end]
    for role, kind, times in reversed(rows):
        out.append(before(role, kind, times, out[-1]))
    return out[::-1]


def table(rows: list[tuple[str, str, int]]) -> list[int]:
    """The cost from each state before the rows to each after them, 4 x 4; inserts after the last row belong to what follows."""
    ways = [cost_to_go(rows, tuple(0 if s == t else NEVER for s in range(4)))[0] for t in range(4)]
    return [min(NEVER, ways[t][s]) for s in range(4) for t in range(4)]


def through(way: list[int], after: Costs) -> Costs:
    """Cost-to-go before a chunk with this table."""
    return tuple(min(way[4 * s + t] + after[t] for t in range(4)) for s in range(4))


def walk(rows: list[tuple[str, str, str, int]], costs: list[Costs], state: int, last: bool) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state after it): ASCII-least tight edits over rows of (role, text, fault, times)."""

    def inserted(at: Costs, to: Costs, state: int) -> bool:
        return at[state] == INSERT + to[NEXT[state]]

    for (role, text, kind, times), at, after in zip(rows, costs, costs[1:]):
        left = times
        while True:
            # of identical rows the first may stay, the others go; deleting is ASCII-least, so all that can go first do
            gone = DELETE * left
            if kind in ("blank", "duplicate") or gone + after[state] == at[state]:
                if gone + after[state] == at[state]:
                    for _ in range(left):
                        yield "D", "", "", state
                    break
            if inserted(at, at, state):
                role_in, state = WANTED[state], NEXT[state]
                yield "I", role_in, "", state
                continue
            rest, add = DELETE * (left - 1), CUT_OFF if kind == "truncated" else 0
            to = _kept(role, state)
            if to is not None and KEEP + add + rest + after[to] == at[state]:
                edit, role_out, state = "K", role, to
            else:
                edit, role_out, state = "R", WANTED[state], NEXT[state]
            yield edit, role_out, text, state
            for _ in range(left - 1):
                yield "D", "", "", state
            break
    if last:
        while costs[-1][state]:
            role_in, state = WANTED[state], NEXT[state]
            yield "I", role_in, "", state


CHUNKS = "conv long, part int, chunk int, turns array<bigint>, roles array<string>, texts array<string>, times array<bigint>, faults array<string>, ways array<bigint>"


def counted(turns: DataFrame, *, conv: str, turn: str, role: str, text: str, times: Column | None = None) -> DataFrame:
    """(c, n, r, x, m, seen): each different row once with how often it stands there, and whether its role and text stand earlier."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(quoted(conv)).cast("long").alias("c"), F.col(quoted(turn)).cast("long").alias("n"), F.coalesce(F.col(quoted(role)).cast("string"), space).alias("r"), F.coalesce(F.col(quoted(text)).cast("string"), space).alias("x"),
        (F.lit(1) if times is None else times).cast("long").alias("m"),
    )
    once = rows.groupBy("c", "n", "r", "x").agg(F.sum("m").alias("m"))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("c").cast("string"), space), F.length("r").cast("string"), "r", "x"), 256)
    once = once.withColumn("k", key)
    first = once.groupBy("k").agg(F.min("n").alias("first"), F.bool_or(F.col("n").isNull()).alias("ahead"))
    seen = F.col("n").isNotNull() & (F.col("ahead") | (F.col("n") > F.col("first")))  # a null turn is ahead of all
    return once.join(first, "k").select("c", "n", "r", "x", "m", seen.alias("seen"))


def chunks(rows: DataFrame) -> DataFrame:
    """The rows of ``counted`` as consecutive chunks of one conversation each; a chunk that isn't surely all of its conversation has its cost table."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "c", "n", *short_keys("r", "x")).sortWithinPartitions("c", "n", "r", "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, out, held, size, conv, begun = TaskContext.get().partitionId(), 0, [], [], 0, None, False

        def flush(over: bool) -> None:
            """``over``: the conversation ends here; ``begun``: this chunk is where it began."""
            nonlocal chunk, held, size, begun
            n, r, x, m, seen = map(list, zip(*held))
            kinds = [fault(text, dup) for text, dup in zip(x, seen)]
            out.append((conv, part, chunk, n, r, x, m, kinds, None if over and begun else table(list(zip(r, kinds, m)))))
            chunk, held, size, begun = chunk + 1, [], 0, over

        def made() -> pa.RecordBatch:
            nonlocal out
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        for b in batches:
            for c, *row in zip(*(b.column(name).to_pylist() for name in ("c", "n", "r", "x", "m", "seen"))):
                if held and (c != conv or len(held) == CHUNK_ROWS or size >= CHUNK_BYTES):
                    flush(c != conv)
                conv = c
                held.append(row)
                size += len(row[1]) + len(row[2])
            if out:
                yield made()
        if held:
            flush(False)
        if out:
            yield made()

    return dealt.mapInArrow(pack, CHUNKS)


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class Repair:
    """One conversation, fed the cost tables of its chunks and then the chunks, both in order."""

    def __init__(self, conv: int | None):
        self.conv, self.ways, self.at = conv, [], 0
        self.costs: list[Costs] | None = None
        self.total = 0
        self.state, self.audit = 0, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.previous = self.turn = None
        self.distinct = 0
        self.sha, self.any = hashlib.sha256(), False

    def add(self, turns: list, roles: list, texts: list, times: list, kinds: list) -> Iterator[tuple[str, str]]:
        """The repaired turns that the chunk gives."""
        if self.costs is None:  # before each chunk but the first, and the end
            self.costs = [END]
            for way in reversed(self.ways[1:]):
                self.costs.append(through(way, self.costs[-1]))
            self.costs.reverse()
        for n, role, kind, m in zip(turns, roles, kinds, times):
            if n is not None:
                if n != self.turn:
                    self.distinct += 1
                self.low = n if self.low is None else self.low
                self.high = self.turn = n
            if kind == "blank":
                self.counts["blank"] += m
            else:
                self.counts["duplicate"] += m - (kind != "duplicate")
                self.counts["truncated"] += kind == "truncated"
            first = role[:1]
            if self.previous is not None and self.previous + first not in LEGAL:
                self.counts["illegal"] += 1
            if first + first not in LEGAL:
                self.counts["illegal"] += m - 1
            self.previous = first
        rows = list(zip(roles, texts, kinds, times))
        costs = cost_to_go(list(zip(roles, kinds, times)), self.costs[self.at])
        self.at += 1
        if self.at == 1:
            self.total = costs[0][0]
        for edit, role, text, self.state in walk(rows, costs, self.state, self.at == len(self.ways)):
            self.audit.append(edit)
            if edit != "D":
                self.sha.update(f"{chr(10) * self.any}{role}:{text}".encode())
                self.any = True
                yield role, text

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, gaps, *self.counts.values(), self.total, "".join(self.audit), self.sha.hexdigest()


def _repair(turns: DataFrame, texts: bool, names: dict[str, str], times: Column | None) -> DataFrame:
    made = materialise(chunks(counted(turns, times=times, **names)), "repair-chunks")
    spark = turns.sparkSession
    null = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in CHUNKS.split(", ")[3:8])]
    tables = made.select("conv", "part", "chunk", *null, "ways", F.lit(0).alias("kind"))
    bodies = made.withColumns({"ways": F.lit(None).cast("array<bigint>"), "kind": F.lit(1)})
    both = tables.unionByName(bodies).repartition(shuffle_partitions(spark), "conv").sortWithinPartitions("conv", "kind", "part", "chunk")
    schema = "conv_id long, position long, role string, text string" if texts else REPAIRED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size, position = None, [], 0, 0
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if texts else [pa.int64()] * 7 + [pa.string()] * 2

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            rows, out, size = out, [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

        for b in batches:
            for i in range(b.num_rows):
                conv, kind = b.column("conv")[i].as_py(), b.column("kind")[i].as_py()
                if now is None or conv != now.conv:
                    if now is not None and not texts:
                        out.append(now.row())
                    now, position = Repair(conv), 0
                if kind == 0:
                    now.ways.append(b.column("ways")[i].as_py())
                    continue
                for role, text in now.add(*(b.column(c)[i].as_py() for c in ("turns", "roles", "texts", "times", "faults"))):
                    if texts:
                        position, size = position + 1, size + len(text)
                        out.append((conv, position, role, text))
                        if size > CHUNK_BYTES or len(out) > 10_000:
                            yield flush()
            if out:
                yield flush()
        if now is not None and not texts:
            out.append(now.row())
        if out:
            yield flush()

    return both.select("conv", "kind", "turns", "roles", "texts", "times", "faults", "ways").mapInArrow(run, schema)


def repaired(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """(conv_id, position, role, text): the repaired turns, from 1.  ``times``: how often a row stands there, if not once."""
    return _repair(turns, True, {"conv": conv, "turn": turn, "role": role, "text": text}, times)


def report(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """A row for each conversation: faults found, cost and initials of the edits, digest of the repaired turns."""
    return _repair(turns, False, {"conv": conv, "turn": turn, "role": role, "text": text}, times)


def damage(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with made faults, by crc32(``conv:turn``) % 20; ``times`` is 2 for those that stand twice."""
    space = F.lit(" ")
    rows = turns.select(F.col(quoted(conv)).cast("long").alias("conv_id"), F.col(quoted(turn)).cast("long").alias("turn"), F.coalesce(F.col(quoted(role)).cast("string"), space).alias("role"), F.coalesce(F.col(quoted(text)).cast("string"), space).alias("text"))
    which = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    return rows.withColumn("hit", which).where("hit <> 0").select(
        "conv_id", "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 3, 2).otherwise(1).alias("times"),
    )
