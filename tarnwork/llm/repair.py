"""Conversation structure repair: A* on the lattice of edits of one conversation.

A node is (rows read, state of ``(s?(ua)+)?``). Edits are Keep (0), Rerole to user or
assistant (2), Delete (3, the only one for blank and repeated rows) and Insert of an empty
user or assistant row (2); a truncated row that stays costs 1 more. The heuristic of a node
is the suffix sum of what the rows ahead cost in any case: 3 for a row that must go, 1 for
a truncated one. No edit lowers it by more than its own cost, so it is consistent. The heap
is keyed by (cost plus heuristic, audit), audit being the initials of the edits so far.
Paths of one cost to one node are never prefixes of one another (what the longer one adds
would be insertions, which cost), so the first arrival at a node is its cheapest and, of
the cheapest, the one with the least audit.

Conversations above ``SEGMENT`` rows are searched segment by segment: the best path between
any two states of a segment's ends is part of the best whole path, by the same argument, so
the result does not change, while heap and audits stay small.

Plan: one shuffle by conversation, a sort inside the partitions, and one pass that holds one
conversation at a time. A conversation is one task's work: its repaired rows are one ordered
value, so it must fit into one row.

Edge cases: null role and text are one space (so a null text is blank). Null turns come
first, rows of one turn by role and text. A null conversation id is a conversation of its
own. A role that begins with none of s, u, a, an empty one too, can be renamed or deleted
only. Rows whose ``present`` is false name their conversation and are otherwise absent; a
conversation of such rows alone has zeros, an empty audit and no repaired rows. Rows that
repeat are repeated messages. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import WHITESPACE

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # what an edit or a charge costs
SEGMENT = 512
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # what the last row kept was
_KEPT = {("s", BEGIN): SYSTEM, ("u", BEGIN): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_MADE = {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # by a row whose role we choose
_FINAL = (BEGIN, ASSISTANT)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}

REPAIRED = "conv_id STRING, gaps LONG, blank LONG, duplicate LONG, truncated LONG, illegal LONG, cost LONG, audit STRING, repaired ARRAY<STRUCT<role: STRING, text: STRING>>"


def faults(rows: Sequence[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        said = row[1].rstrip(WHITESPACE)
        out.append("blank" if not said else "duplicate" if row in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add(row)
    return out


def arrivals(rows: Sequence[tuple[str, str]], state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, audit) at the end of ``rows`` (role initial, fault), cheapest and least first; each state once."""
    ahead = [0]
    for _, fault in reversed(rows):
        ahead.append(ahead[-1] + {"blank": DELETE, "duplicate": DELETE, "truncated": TRUNCATED}.get(fault, 0))
    ahead.reverse()
    heap, done = [(ahead[0], "", 0, state)], set()
    while heap:
        key, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        cost = key - ahead[at]
        made = _MADE[state]
        heapq.heappush(heap, (key + INSERT, audit + "I", at, made))
        if at == len(rows):
            yield state, cost, audit
            continue
        (initial, fault), after = rows[at], cost + ahead[at + 1]
        heapq.heappush(heap, (after + DELETE, audit + "D", at + 1, state))
        if fault not in ("blank", "duplicate"):
            charge = TRUNCATED if fault else 0
            heapq.heappush(heap, (after + REROLE + charge, audit + "R", at + 1, made))
            if (initial, state) in _KEPT:
                heapq.heappush(heap, (after + KEEP + charge, audit + "K", at + 1, _KEPT[initial, state]))


def cheapest(rows: Sequence[tuple[str, str]], segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit) of the best edit of whole ``rows`` (role initial, fault)."""
    best = {BEGIN: (0, "")}
    cut = max(0, (len(rows) - 1) // segment) * segment  # where the last segment begins
    for first in range(0, cut, segment):
        reached: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in best.items():
            for end, more, letters in arrivals(rows[first : first + segment], state):
                found = (cost + more, audit + letters)
                reached[end] = min(found, reached.get(end, found))
        best = reached
    last = rows[cut:]
    ends = (next((c, a) for end, c, a in arrivals(last, state) if end in _FINAL) for state in best)
    return min((cost + more, audit + letters) for (cost, audit), (more, letters) in zip(best.values(), ends, strict=True))


def edited(rows: Sequence[tuple[str, str]], audit: str) -> list[dict[str, str]]:
    """The (role, text) rows that the edits ``audit`` make of ``rows``."""
    out, state, ahead = [], BEGIN, iter(rows)
    for letter in audit:
        role, text = next(ahead) if letter != "I" else ("", "")
        if letter == "D":
            continue
        state = _KEPT[role[:1], state] if letter == "K" else _MADE[state]
        out.append({"role": role if letter == "K" else _ROLE[state], "text": text})
    return out


def repaired(turns: Sequence[int | None], rows: Sequence[tuple[str, str]]) -> dict:
    """One conversation's faults, cheapest edit and rows after it."""
    fault = faults(rows)
    initials = [role[:1] for role, _ in rows]
    cost, audit = cheapest(list(zip(initials, fault, strict=True)))
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0, **{kind: fault.count(kind) for kind in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit, "repaired": edited(rows, audit),
    }


def _repair_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    message = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.string()), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired", pa.list_(message))])
    held: list[dict] = []
    size = 0
    for conv, group in groupby(rows, key=lambda r: r[0]):
        there = [r for r in group if r[4]]
        held.append({"conv_id": conv, **repaired([r[1] for r in there], [(r[2], r[3]) for r in there])})
        size += sum(len(r[3]) for r in there) + 100
        if size > 1 << 22:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of every conversation of (conv_id, turn, role, text)."""
    ident = dict(rows.dtypes)["conv_id"]
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    said = rows.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), there.alias("present"),
    )
    dealt = said.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(_repair_pass, REPAIRED).withColumn("conv_id", F.col("conv_id").cast(ident))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): every twentieth row or so dropped, emptied, cut, repeated or given to the user.

    Which, is the remainder by 20 of the CRC-32 of ``conv_id:turn``; nulls are one space.
    A dropped row stays as a row that is not present, so that no conversation is lost.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    made = marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(copies).alias("copy"))
    return made.drop("copy")


def repair_report(rows: DataFrame) -> DataFrame:
    """What :func:`repair` says of the damaged ``rows``, its repaired rows as one digest."""
    out = repair(damaged(rows), F.col("present"))
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
