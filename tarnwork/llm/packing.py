"""Variable-capacity best-fit packing of documents into training sequences.

Permitted sequence lengths are planned jointly: items go, longest first, into the open
bin with the least room that fits; if none fits, the least-cost permitted bin is opened;
at the end every bin is downsized to the smallest permitted length that holds its
contents. Which opening rule is least-cost depends on what later fills the bins, so each
rule (a largest length to open, or the least cost a token) is planned and the cheapest
total, after downsizing, is taken. Texts longer than the largest length are cut into full
pieces and a rest.

Scale: the plan needs only the histogram of piece lengths, at most ``max(lengths)`` rows
whatever the corpus, so planning runs on the driver over counts, never over documents:
bins that are filled alike are one group of the plan. Pieces are then numbered inside
their length (salted, so that a length held by a third of all documents is spread) and
look their bin up in the plan. Texts are never shuffled.

Edge cases: null and empty texts are one end-of-document unit long. Every row is packed,
repeated rows and null ids included. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.llm.common import parallelism, write_table

LENGTHS = (2048, 4096, 8192)


def byte_units(text: Column) -> Column:
    """Units of a byte-level tokenizer, and one for the end of the document."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def attention_cost(length: int) -> float:
    """Relative cost of a sequence: linear layers and attention."""
    return length * (1 + length / 32_768)


@dataclass
class Plan:
    """Arrays, one entry an interval of equally long pieces, and one a group of bins."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # ordinal of the interval's first piece
    bin_from: list[int] = field(default_factory=list)
    per_bin: list[int] = field(default_factory=list)
    used: list[int] = field(default_factory=list)  # units taken in each bin before
    group_from: list[int] = field(default_factory=list)
    group_bins: list[int] = field(default_factory=list)
    group_used: list[int] = field(default_factory=list)

    def cost(self, lengths: tuple[int, ...], cost_of: Callable[[int], float]) -> float:
        return sum(n * cost_of(lengths[bisect_left(lengths, u)]) for n, u in zip(self.group_bins, self.group_used, strict=True))


def best_fit(counts: dict[int, int], open_for: Callable[[int], int]) -> Plan:
    """Best-fit decreasing on (length -> count); equal bins move as one group."""
    plan = Plan()
    rooms: list[int] = []  # sorted distinct rooms of open groups
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, capacity)
    bins = 0

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append(group)

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n, capacity = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                capacity = room = open_for(length)
                n = -(-left // (capacity // length))
                start, bins = bins, bins + n
            fits = room // length
            full = min(n, left // fits)
            rest = left - full * fits if full < n else 0
            for take, many in ((fits, full), (rest, 1)):
                if take and many:
                    for name, value in (("length", length), ("first", done), ("bin_from", start), ("per_bin", take), ("used", capacity - room)):
                        getattr(plan, name).append(value)
                    put(room - take * length, (start, many, capacity))
                    start, n, done, left = start + many, n - many, done + take * many, left - take * many
            if n:
                put(room, (start, n, capacity))
    for room, held in groups.items():
        for start, n, capacity in held:
            plan.group_from.append(start)
            plan.group_bins.append(n)
            plan.group_used.append(capacity - room)
    return plan


def cheapest_plan(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost_of: Callable[[int], float] = attention_cost) -> Plan:
    lengths = tuple(sorted(lengths))

    def least_cost(units: int) -> int:
        return min((c for c in lengths if c >= units), key=lambda c: (cost_of(c) / (c // units * units), c))

    rules = [least_cost] + [lambda units, top=top: next((c for c in (top, *lengths) if c >= units)) for top in lengths]
    return min((best_fit(counts, rule) for rule in rules), key=lambda p: p.cost(lengths, cost_of))


def pieces_of(docs: DataFrame, units: Column, most: int) -> DataFrame:
    """(doc_id, piece, start, length): documents cut at multiples of ``most``."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), units.alias("__units"))
    cut = sized.select("doc_id", "__units", F.explode(F.sequence(F.lit(0), F.floor((F.col("__units") - 1) / most).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * most
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("__units") - start, F.lit(most)).cast("int").alias("length"))


def numbered(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with ``ordinal``, from 0 inside each length, without one task a length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    local = salted.withColumn("local", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return local.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"]).select("doc_id", "piece", "start", "length", (F.col("before") + F.col("local") - 1).alias("ordinal"))


def _place_pass(plan: Plan, lengths: tuple[int, ...]):
    length, first = np.array(plan.length, np.int64), np.array(plan.first, np.int64)
    order = np.lexsort((first, length))
    key = (length << 40)[order] + first[order]
    cols = [np.array(x, np.int64)[order] for x in (plan.first, plan.bin_from, plan.per_bin, plan.used)]
    by = np.argsort(np.array(plan.group_from, np.int64))
    group_from, group_used = (np.array(x, np.int64)[by] for x in (plan.group_from, plan.group_used))
    allowed = np.array(lengths, np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size, ordinal = pdf["length"].to_numpy(np.int64), pdf["ordinal"].to_numpy(np.int64)
            at = np.searchsorted(key, (size << 40) + ordinal, side="right") - 1
            start, bin_from, per_bin, used = (c[at] for c in cols)
            turn, slot = np.divmod(ordinal - start, per_bin)
            bin_id = bin_from + turn
            held = group_used[np.searchsorted(group_from, bin_id, side="right") - 1]
            out = pdf[["doc_id", "piece", "start", "length"]].copy()
            out["bin_id"], out["bin_offset"] = bin_id, used + slot * size
            out["bin_length"] = allowed[np.searchsorted(allowed, held)]
            yield out

    return run


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, units: Column | None = None, cost_of: Callable[[int], float] = attention_cost) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, bin_id, bin_offset, bin_length (units)."""
    lengths = tuple(sorted(lengths))
    units = byte_units(F.col("text").cast("string")) if units is None else units
    pieces = write_table(pieces_of(docs, units, lengths[-1]), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max(lengths) rows
    plan = cheapest_plan(counts, lengths, cost_of)
    schema = "doc_id long, piece int, start long, length int, bin_id long, bin_offset long, bin_length int"
    return numbered(pieces, parallelism(docs.sparkSession)).mapInPandas(_place_pass(plan, lengths), schema)
