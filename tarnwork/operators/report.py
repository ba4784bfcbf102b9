"""Histories, schedules, parity and accuracy reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.columns import dot, first_argmax, normalised_value


def upsert_history(history: DataFrame, updates: DataFrame) -> DataFrame:
    """(epoch, metric, value): an epoch in ``updates`` replaces the whole earlier record.

    Null metrics are left out. Both have (epoch, seq, metric, value); the largest seq of an
    epoch is the one that counts.
    """
    every = history.unionByName(updates)
    latest = every.groupBy("epoch").agg(F.max("seq").alias("seq"))
    return every.join(latest, ["epoch", "seq"], "left_semi").where("value IS NOT NULL").select("epoch", "metric", "value")


def learning_rate(step: Column, steps: int, warmup: int, lr: float, min_lr: float) -> Column:
    """The rate at a step: linear warm-up, then a cosine down to min_lr, where it stays."""
    turn = F.least((step - warmup) / max(1, steps - warmup), F.lit(1.0))
    cosine = min_lr + (lr - min_lr) * 0.5 * (1 + F.cos(math.pi * turn))
    return F.when(step < warmup, lr * (step + 1) / max(1, warmup)).otherwise(cosine)


def lr_schedule(spark: SparkSession, steps: int, warmup: int, lr: float, min_lr: float) -> DataFrame:
    """(step, lr) of all steps."""
    return spark.range(steps).select(F.col("id").alias("step"), learning_rate(F.col("id"), steps, warmup, lr, min_lr).alias("lr"))


def metric_lines(metrics: DataFrame, ident: str, keys: Sequence[str], places: int = 4) -> DataFrame:
    """(ident, line) of (ident, metric, value): ``key=value`` in the order of ``keys``, a dash for what is not there."""
    known = metrics.where(F.col("metric").isin(*keys)).groupBy(ident).agg(*[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(f"m{i}") for i, k in enumerate(keys)])
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.format_string(f"%.{places}f", F.col(f"m{i}").cast("double")), F.lit("-"))) for i, k in enumerate(keys)]
    shown = [F.when(F.col(f"m{i}").isNull(), F.lit(f"{k}=-")).otherwise(part) for i, (k, part) in enumerate(zip(keys, parts, strict=True))]
    return metrics.select(ident).distinct().join(known, ident, "left").select(ident, F.concat_ws(" ", *shown).alias("line"))


def best_epochs(history: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(epoch, score, loss, is_best): an ordered fold over (epoch, score, loss).

    Better is a score above the best by the tolerance, or an equal one with less loss. The
    fold is not associative; it runs over one row an epoch.
    """
    rows = F.array_sort(F.collect_list(F.struct("epoch", "score", "loss")))
    kind = "ARRAY<STRUCT<epoch: BIGINT, score: DOUBLE, loss: DOUBLE, is_best: BOOLEAN>>"
    zero = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("l"), F.expr(f"CAST(array() AS {kind})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        better = acc["s"].isNull() | (x["score"] > acc["s"] + tolerance) | ((F.abs(x["score"] - acc["s"]) <= tolerance) & (x["loss"] < acc["l"]))
        row = F.struct(x["epoch"].cast("long").alias("epoch"), x["score"].alias("score"), x["loss"].alias("loss"), better.alias("is_best"))
        return F.struct(F.when(better, x["score"]).otherwise(acc["s"]).alias("s"), F.when(better, x["loss"]).otherwise(acc["l"]).alias("l"), F.concat(acc["out"], F.array(row)).alias("out"))

    return history.agg(F.aggregate(rows, zero, step, lambda acc: acc["out"]).alias("rows")).select(F.inline("rows"))


def parity(ref: DataFrame, got: DataFrame, tolerance: float) -> DataFrame:
    """(output, max_abs, n_over, n): differences of (item, output, value) pairs."""
    both = ref.join(got.withColumnRenamed("value", "other"), ["item", "output"])
    gap = F.abs(F.col("value") - F.col("other"))
    return both.groupBy("output").agg(F.max(gap).alias("max_abs"), F.count_if(gap > tolerance).alias("n_over"), F.count("*").alias("n"))


def vector_parity(ref: DataFrame, got: DataFrame, tolerance: float, least_cosine: float) -> DataFrame:
    """(output, max_abs, min_cosine, n_mismatch, n, ok) of (item, output, v) pairs; a mismatch is another first maximum."""
    both = ref.join(got.withColumnRenamed("v", "w"), ["item", "output"])
    gap = F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b)))
    cosine = dot(F.col("v"), F.col("w")) / F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("w"), F.col("w"))), F.lit(1e-12))
    other = first_argmax(F.col("v")) != first_argmax(F.col("w"))
    out = both.groupBy("output").agg(F.max(gap).alias("max_abs"), F.min(cosine).alias("min_cosine"), F.count_if(other).alias("n_mismatch"), F.count("*").alias("n"))
    return out.withColumn("ok", (F.col("max_abs") <= tolerance) & (F.col("min_cosine") >= least_cosine))


def running_means(steps: DataFrame) -> DataFrame:
    """(metric, mean, n) of (metric, value): values that are not finite do not count."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return steps.groupBy("metric").agg(F.avg(finite).alias("mean"), F.count(finite).alias("n"))


def overridden(base: DataFrame, over: DataFrame) -> DataFrame:
    """(key, value): ``base`` with the entries of ``over`` in their place or added; an explicit null counts."""
    kept = base.join(over.select("key"), "key", "left_anti")
    return kept.select("key", "value").unionByName(over.select("key", "value"))


def incompatible(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, ours, theirs): entries of two manifests (key, value) that are not equal; a checkpoint fits if there are none."""
    both = ours.withColumnRenamed("value", "ours").join(theirs.withColumnRenamed("value", "theirs"), "key", "full")
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("key", "ours", "theirs")


def first_by_priority(items: DataFrame, split: str, ident: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` items, those of earlier splits first; splits that ``order`` lacks take no part."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    return items.where(rank > 0).orderBy(rank, ident).limit(n)


def field_accuracy(predicted: DataFrame, truth: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(field, ok, total, rate): by value, lists in any order, rows without truth left out."""
    both = predicted.alias("p").join(truth.alias("t"), key)
    kinds = dict(predicted.dtypes)

    def value(side: str, c: str) -> Column:
        x = F.col(f"{side}.{c}")
        return normalised_value(x).cast("string") if kinds[c].startswith("array") else x.cast("string")

    each = F.array(*[F.struct(F.lit(c).alias("field"), value("p", c).eqNullSafe(value("t", c)).alias("ok")) for c in fields])
    return both.select(F.explode(each).alias("x")).groupBy("x.field").agg(F.count_if("x.ok").alias("ok"), F.count("*").alias("total"), F.avg(F.col("x.ok").cast("double")).alias("rate"))


def fingerprint(rows: DataFrame, *cols: str) -> DataFrame:
    """One row: 16 hex digits over all rows, whatever their order.

    A sum of row hashes is combined map side; no row leaves its task.
    """
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return rows.agg(F.substring(F.sha1(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(h), F.lit(0)).cast("string"))), 1, 16).alias("fingerprint"))


def align_keys(required: DataFrame, supplied: DataFrame, prefixes: list[str]) -> DataFrame:
    """(key, supplied_key, fault) under the prefix with most keys in common.

    All or nothing: any row with a fault (missing, shape) rejects the load; supplied keys
    that nothing asks for are ignored.
    """
    tried = supplied.select(F.col("key").alias("supplied_key"), F.col("shape").alias("got"), F.explode(F.array(*map(F.lit, prefixes))).alias("prefix"))
    tried = tried.where(F.col("supplied_key").startswith(F.col("prefix"))).withColumn("key", F.expr("substring(supplied_key, length(prefix) + 1)"))
    hits = tried.join(required.select("key"), "key", "left_semi").groupBy("prefix").count()
    best = hits.orderBy(F.desc("count"), F.length("prefix"), "prefix").limit(1)
    chosen = tried.join(best.select("prefix"), "prefix", "left_semi").select("key", "supplied_key", "got")
    both = required.join(chosen, "key", "left")
    return both.select("key", "supplied_key", F.when(F.col("supplied_key").isNull(), "missing").when(F.col("shape") != F.col("got"), "shape").alias("fault"))
