"""Repair of the structure of conversations, as a cheapest path through an edit lattice.

A conversation should read: perhaps a system turn, then user and assistant in
turn, ending with the assistant; or nothing at all. A node of the lattice is a
number of turns read and what was written last (nothing, system, user,
assistant); an edge is an edit: keep a turn, give it the role that is due,
delete it, or insert an empty turn of that role. Every node has at most one edge
of each kind, so the initials of the edits, the audit, name the path.

The cheapest path is found by Dijkstra's search from both ends: a forward and a
reverse heap take turns until what both still hold is dearer than the best
meeting. All meetings of that cost are finished, and the least of their
concatenated audits is taken. Labels are (cost, least audit): two audits of
equal cost at one node are never one the beginning of the other (the longer one
would end in inserts, which cost something), so least parts make the least
whole.

Scale: turns are sorted by ranges of (conversation, turn), so a conversation
with a third of all turns lies in many tasks. Each task cuts its turns into
blocks of at most ``block`` and searches each block, for a block that may not
begin or end its conversation from and to every state. Costs and audits of
blocks are joined per conversation in order; that step holds four audits. The
repaired turns are a sorted stream in which the audit comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageprism.llm.common import in_arrow, materialize

# What was written last; the first is also where a conversation begins.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (NOTHING, ASSISTANT)
#: What each initial leads to.
_KEEP = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The role that is due, as a state; a system turn is never made.
_DUE = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
#: Added when a truncated turn is not deleted.
TRUNCATED = 3
_FAULTS = ("blank", "duplicate", "truncated")
#: A character that is not ASCII white space.
_INK = "[^\\x20\\x09-\\x0D]"

Turn = tuple[str, str]  # first letter of the role (or none), first fault (or none)
Label = tuple[int, str]  # cost and audit


def _steps(turn: Turn, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state behind it) of the edits of one turn."""
    letter, fault = turn
    out = [("D", COSTS["D"], state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if (state, letter) in _KEEP:
            out.append(("K", COSTS["K"] + more, _KEEP[state, letter]))
        out.append(("R", COSTS["R"] + more, _DUE[state]))
    return out


def _forward(turns: list[Turn], i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, turns read, state) of the edges out of a node."""
    out = [("I", COSTS["I"], i, _DUE[state])]
    if i < len(turns):
        out += [(e, c, i + 1, s) for e, c, s in _steps(turns[i], state)]
    return out


def _reverse(turns: list[Turn], i: int, state: int) -> list[tuple[str, int, int, int]]:
    """The same of the edges into a node."""
    out = [("I", COSTS["I"], i, s) for s in STATES if _DUE[s] == state]
    if i:
        out += [(e, c, i - 1, s) for s in STATES for e, c, t in _steps(turns[i - 1], s) if t == state]
    return out


class _Side:
    """One of the two searches: labels, heap and settled nodes."""

    def __init__(self, begin: list[tuple[int, int]], sign: int):
        self.sign = sign
        self.labels: dict[tuple[int, int], Label] = {node: (0, "") for node in begin}
        # of equal costs the node nearest to the own end is settled first: only then are its audits final, as keeping is free
        self.heap = [(0, sign * i, s) for i, s in sorted(begin)]
        self.settled: set[tuple[int, int]] = set()

    def top(self) -> int | None:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple[int, int]:
        _, i, s = heappop(self.heap)
        self.settled.add((self.sign * i, s))
        return self.sign * i, s

    def offer(self, node: tuple[int, int], label: Label) -> None:
        have = self.labels.get(node)
        if have is None or label < have:
            self.labels[node] = label
            heappush(self.heap, (label[0], self.sign * node[0], node[1]))


def cheapest(turns: list[Turn], begin: int, ends: tuple[int, ...]) -> Label | None:
    """Cost and least audit of the cheapest edits from state ``begin`` to any of ``ends``; None if there are none."""
    ahead, back = _Side([(0, begin)], 1), _Side([(len(turns), s) for s in ends], -1)
    best: int | None = None
    meetings: list[str] = []  # audits of cost ``best``

    def meet(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or cost < best:
            best = cost
            meetings.clear()
        if cost == best:
            meetings.append(audit)

    while True:
        x, y = ahead.top(), back.top()
        # a heap that is empty has settled all it can reach
        if x is None or y is None or (best is not None and x + y > best):
            break
        # the ends themselves first: a path that one side settles alone is met there
        forward = not ahead.settled or (len(back.settled) >= len(ends) and len(ahead.heap) <= len(back.heap))
        here, there, edges = (ahead, back, _forward) if forward else (back, ahead, _reverse)
        node = here.settle()
        cost, audit = here.labels[node]
        if node in there.settled:
            c, rest = there.labels[node]
            meet(cost + c, audit + rest if here is ahead else rest + audit)
        for initial, c, i, s in edges(turns, *node):
            longer = audit + initial if here is ahead else initial + audit
            if (i, s) in there.settled:
                d, rest = there.labels[i, s]
                meet(cost + c + d, longer + rest if here is ahead else rest + longer)
            if (i, s) not in here.settled:
                here.offer((i, s), (cost + c, longer))
    return None if best is None else (best, min(meetings))


# ---- turns and their faults -----------------------------------------------------------------------------------------
def numbered(turns: DataFrame) -> DataFrame:
    """Turns under fixed names, nulls as one blank (but for ``turn``), in their order by ``row``.

    The order is that of ``turn`` (null first), role, text and, if there, ``copy``. It is one of ranges of all turns, so a
    conversation of any size is dealt to many tasks.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copy = F.col("copy").cast("int") if "copy" in turns.columns else F.lit(0)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"), copy.alias("copy")
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()).drop("copy"), "turns")


def _ends_well(text: Column) -> Column:
    return F.regexp_extract(text, f"({_INK})[\\x20\\x09-\\x0D]*\\z", 1).isin(".", "!", "?")


def with_faults(rows: DataFrame) -> DataFrame:
    """Numbered turns with their first ``fault``: blank, duplicate (role and text stand earlier in the conversation), truncated, or null.

    The first of equal turns is a grouped minimum, so a turn that is repeated a million times is a partial row per task.
    Role and text are compared by 96 bits of hashes.
    """
    said = {"h1": F.xxhash64("role", "text"), "h2": F.hash("text", "role")}
    seen = rows.select("conv_id", "row", *[c.alias(n) for n, c in said.items()]).groupBy("conv_id", *said)
    first = materialize(seen.agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first-said")
    first = first.select(*said, F.col("conv_id").alias("conv"), "first")
    same = rows["conv_id"].eqNullSafe(first["conv"])
    for n, c in said.items():
        same = same & (c == first[n])
    fault = (
        F.when(~F.col("text").rlike(_INK), "blank")
        .when(F.col("first") < F.col("row"), "duplicate")
        .when(~_ends_well(F.col("text")), "truncated")
    )
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "row", fault.alias("fault"))


def with_planted_faults(turns: DataFrame) -> DataFrame:
    """Damaged turns (``conv_id``, ``turn``, ``role``, ``text``, ``copy``): nulls are one blank, and by the crc32 of ``conv_id:turn`` modulo 20

    0 drops a turn, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the turn, 4 gives it the role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), h.alias("h")).filter("h != 0")
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )


# ---- blocks, conversations, repaired turns ----------------------------------------------------------------------------
_BLOCK = "conv_id bigint, part int, seq int, begin int, end int, cost bigint, audit string"
_BLOCK_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _searched(rows: DataFrame, block: int) -> DataFrame:
    """Costs and audits of all blocks: one row per block, state at its beginning and state at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        turns: list[Turn] = []
        key, seq, started = None, 0, False
        opens = True  # whether turns of this conversation may lie before this block: in another block or another task

        def search(closes: bool) -> None:
            """``closes``: no turn of the conversation can follow."""
            for begin in STATES if opens else (NOTHING,):
                if closes:
                    found = [(ASSISTANT, cheapest(turns, begin, ENDS))]
                else:
                    found = [(end, cheapest(turns, begin, (end,))) for end in STATES]
                out.extend((key, part, seq, begin, end, *label) for end, label in found if label is not None)

        for batch in batches:
            for conv, letter, fault in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if started and conv != key:
                    search(closes=True)
                    opens, seq, turns = False, 0, []
                elif len(turns) == block:
                    search(closes=False)
                    opens, seq, turns = True, seq + 1, []
                key, started = conv, True
                turns.append((letter, fault or ""))
            if out:
                yield _batch(out, _names(_BLOCK), _BLOCK_KINDS)
                out = []
        if started:
            search(closes=False)  # the next task may have more of it
            yield _batch(out, _names(_BLOCK), _BLOCK_KINDS)

    sorted_rows = rows.repartitionByRange("row").sortWithinPartitions("row")
    return in_arrow(sorted_rows.select("conv_id", F.left("role", F.lit(1)).alias("letter"), "fault"), run, _BLOCK)


def _joined(blocks: DataFrame) -> DataFrame:
    """``conv_id``, ``cost``, ``audit``: the blocks of each conversation one after the other."""
    schema = "conv_id bigint, cost bigint, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, place, started = None, None, False
        before: dict[int, Label] = {NOTHING: (0, "")}
        now: dict[int, Label] = {}

        def close() -> None:
            ends = [now[s] for s in ENDS if s in now]
            out.append((key, *min(ends)))

        for batch in batches:
            for conv, part, seq, begin, end, cost, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != key:
                    if started:
                        close()
                    before, now = {NOTHING: (0, "")}, {}
                elif (part, seq) != place:
                    before, now = now, {}
                started, key, place = True, conv, (part, seq)
                if begin in before:
                    label = (before[begin][0] + cost, before[begin][1] + audit)
                    if end not in now or label < now[end]:
                        now[end] = label
            if out:
                yield _batch(out, _names(schema), [pa.int64(), pa.int64(), pa.string()])
                out = []
        if started:
            close()
            yield _batch(out, _names(schema), [pa.int64(), pa.int64(), pa.string()])

    order = [F.asc_nulls_first("conv_id"), F.asc("part"), F.asc("seq")]
    return in_arrow(blocks.repartition("conv_id").sortWithinPartitions(*order), run, schema)


def audits(faulty: DataFrame, block: int = 2048) -> DataFrame:
    """``conv_id``, ``cost`` and ``audit`` of each conversation with turns (columns of ``with_faults``)."""
    return _joined(materialize(_searched(faulty, block), "blocks"))


_EDIT = "conv_id bigint, place bigint, edit string, role string, text string, turn bigint, fault string, was string"


def _applied(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """Every turn and every inserted one with its edit, in order (``place``). ``role`` and ``text`` are the repaired ones, ``was`` the role before."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, audit, at, state, place = None, "", 0, NOTHING, 0

        def insert() -> None:
            nonlocal at, state, place
            while audit[at : at + 1] == "I":
                state = _DUE[state]
                out.append((key, place, "I", ROLES[state], "", None, None, None))
                at, place = at + 1, place + 1

        for batch in batches:
            for conv, head, line, role, text, turn, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head:  # the audit of the next conversation
                    key, audit, at, state, place = conv, line, 0, NOTHING, 0
                    insert()
                    continue
                edit, was = audit[at], role
                if edit == "K":
                    state = _KEEP[state, role[:1]]
                elif edit == "R":
                    state = _DUE[state]
                    role = ROLES[state]
                out.append((key, place, edit, role, text, turn, fault, was))
                at, place = at + 1, place + 1
                insert()
            if out:
                yield _batch(out, _names(_EDIT), kinds)
                out = []

    none = F.lit(None)
    heads = found.select(
        "conv_id", F.lit(True).alias("head"), F.col("audit").alias("line"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        none.cast("bigint").alias("turn"), none.cast("string").alias("fault"), none.cast("bigint").alias("row"),
    )
    rows = faulty.select("conv_id", F.lit(False).alias("head"), none.cast("string").alias("line"), "role", "text", "turn", "fault", "row")
    both = heads.unionByName(rows).repartition("conv_id")
    both = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("head"), F.asc("row"))
    return in_arrow(both.drop("row"), run, _EDIT)


def repaired(turns: DataFrame, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The edited turns, and ``conv_id``, ``cost``, ``audit`` of every conversation that has turns.

    Of ``turns`` the columns ``conv_id``, ``turn``, ``role``, ``text`` and, if there, ``copy`` are read. Turns are taken by
    ``turn`` (null first), then role, text and copy. Null roles and texts are one blank; rows without ``conv_id`` are one
    conversation. Blank and duplicate turns are always deleted. Edited turns have ``place``, ``edit`` (initial of keep,
    rerole, delete, insert), ``role`` and ``text`` as repaired, ``turn``, ``fault`` and ``was`` (the role before); inserted
    ones have none of these three. Repeated rows are turns of their own. An empty table gives two empty ones.
    """
    faulty = materialize(with_faults(numbered(turns)), "faulty")
    found = materialize(audits(faulty, block), "audits")
    return _applied(faulty, found), found


_LEGAL = {"su", "ua", "au"}
_DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, repaired_sha256 string"


def conversation_reports(edited: DataFrame) -> DataFrame:
    """Per conversation with turns, from its edited turns: gaps in the turn numbers, faults, adjacent roles that should not be, digest of the repaired turns."""
    kinds = [pa.int64()] * 6 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, started = None, False
        low = high = last = None
        distinct = illegal = 0
        counts: dict[str, int] = {}
        before: str | None = None
        digest, first = hashlib.sha256(), True

        def close() -> None:
            gaps = high - low + 1 - distinct if distinct else 0
            out.append((key, gaps, *[counts.get(f, 0) for f in _FAULTS], illegal, digest.hexdigest()))

        for batch in batches:
            for conv, edit, role, text, turn, fault, was in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != key:
                    if started:
                        close()
                    started, key, low, high, last, distinct, illegal, counts, before = True, conv, None, None, None, 0, 0, {}, None
                    digest, first = hashlib.sha256(), True
                if edit != "I":
                    if turn is not None and turn != last:  # turns are in order
                        low, high, last, distinct = turn if low is None else low, turn, turn, distinct + 1
                    if fault:
                        counts[fault] = counts.get(fault, 0) + 1
                    if before is not None and before + was[:1] not in _LEGAL:
                        illegal += 1
                    before = was[:1]
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if out:
                yield _batch(out, _names(_DIGEST), kinds)
                out = []
        if started:
            close()
            yield _batch(out, _names(_DIGEST), kinds)

    rows = edited.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc("place"))
    return in_arrow(rows.select("conv_id", "edit", "role", "text", "turn", "fault", "was"), run, _DIGEST)
