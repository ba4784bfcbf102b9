"""Batches as fixed-shape arrays, and what must hold for them before training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASKS = ("food", "container", "accessory", "rack")


def collated(rows: DataFrame, *fields: str) -> DataFrame:
    """(batch, n, fields): the values of a batch's rows as one array a field, in order of slot.

    ``rows`` has batch and slot. Batches have a fixed size, so no group grows.
    """
    in_order = F.array_sort(F.collect_list(F.struct("slot", *fields)))
    grouped = rows.groupBy("batch").agg(in_order.alias("__rows"))
    return grouped.select("batch", F.size("__rows").alias("n"), *[F.col(f"__rows.{f}").alias(f) for f in fields])  # a field of an array of rows is an array


def _each(tensor: Column) -> tuple[Column, Column]:
    """(finite, value) of all components of a batch's vectors, null vectors and components as not finite."""
    parts = F.flatten(F.transform(tensor, lambda v: F.coalesce(v.cast("array<double>"), F.array(F.lit(None).cast("double")))))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.forall(parts, finite), F.filter(parts, finite)


def checked(batches: DataFrame, tensor: str, width: int, size: int | None = None) -> DataFrame:
    """``batches`` with ``least``, ``most`` (over finite components) and ``faults`` of the array column ``tensor``.

    Faults, all that apply: shape (a vector is null or not ``width`` long), not_finite (a
    component is null, not a number or infinite), size (fewer or more rows than ``size``).
    """
    finite, values = _each(F.col(tensor))
    wrong = F.exists(tensor, lambda v: F.coalesce(F.size(v) != width, F.lit(True)))
    found = [F.when(wrong, "shape"), F.when(~finite, "not_finite")] + ([F.when(F.col("n") != size, "size")] if size is not None else [])
    return batches.withColumns({"least": F.array_min(values), "most": F.array_max(values), "faults": F.array_compact(F.array(*found))})


def loader_faults(report: DataFrame) -> DataFrame:
    """(fault, n) over all batches of :func:`checked`; ``no_batches`` if there are none."""
    counts = report.agg(F.count("*").alias("batches"), *[F.count_if(F.array_contains("faults", f)).alias(f) for f in ("shape", "not_finite", "size")])
    none = F.when(F.col("batches") == 0, 1).otherwise(0).cast("long")
    rows = F.array(*[F.struct(F.lit(f).alias("fault"), (none if f == "no_batches" else F.col(f)).alias("n")) for f in ("no_batches", "shape", "not_finite", "size")])
    return counts.select(F.inline(rows)).where("n > 0")


def batch_counts(rows: DataFrame, tasks: Sequence[str] = TASKS) -> DataFrame:
    """(batch, field, value, n) of encoded rows with batch: rows of every group and rows that each task can learn from.

    ``proj`` are rows with a company group; other tasks have a column ``<task>_known``.
    """
    valid = {"is_oven": F.lit(True), "proj": F.col("group_id") >= 0} | {t: F.col(f"{t}_known") for t in tasks}
    sums = rows.groupBy("batch").agg(*[F.count_if(when).alias(t) for t, when in valid.items()])
    by_task = sums.select("batch", F.lit("task").alias("field"), F.inline(F.array(*[F.struct(F.lit(t).alias("value"), F.col(t).alias("n")) for t in valid])))
    by_group = rows.groupBy("batch", F.col("group_id").cast("string").alias("value")).agg(F.count("*").alias("n")).select("batch", F.lit("group").alias("field"), "value", "n")
    return by_task.unionByName(by_group)


def first_batches(batches: DataFrame, n: int) -> DataFrame:
    """The batches before the n-th."""
    return batches.where(F.col("batch") < n)
