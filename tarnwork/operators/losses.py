"""Masked multi-task losses as aggregates: forward values, in doubles.

A loss over no valid row is 0 (a metric over none is null). Batch values keep their
(sum, count), so that the mean over any partition into batches is the mean over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import dot, l2_normalised, let, level_mask, total

CENTRES = 4_096  # class centres a task
ITEMS = 32_768  # items a task


def bce(logit: Column, target: Column, pos_weight: Column | float = 1.0) -> Column:
    """Stable binary cross entropy with logits."""
    w = F.lit(pos_weight) if isinstance(pos_weight, int | float) else pos_weight
    soft = F.log1p(F.exp(-F.abs(logit)))
    return w * target * (soft + F.greatest(-logit, F.lit(0.0))) + (1 - target) * (soft + F.greatest(logit, F.lit(0.0)))


def focal(logit: Column, target: Column, gamma: float = 2.0, pos_weight: Column | float = 1.0) -> Column:
    p = 1 / (1 + F.exp(-logit))
    return bce(logit, target, pos_weight) * F.pow(1 - (p * target + (1 - p) * (1 - target)), F.lit(gamma))


def masked_mean(value: Column, valid: Column) -> Column:
    return F.coalesce(F.avg(F.when(valid, value)), F.lit(0.0))


def level_cross_entropy(raw: Column, level: Column, rack_count: Column, floor_usable: Column, smooth: float = 0.0) -> Column:
    """Cross entropy of masked level logits; smoothing goes to neighbouring rails only."""

    def weight(k: Column) -> Column:
        near = (F.abs(k - level) == 1) & (level >= 1) & (k >= 1) & (k <= rack_count)
        return F.when(k == level, 1.0 - smooth).when(near, smooth / 2).otherwise(0.0)

    def norm(v: Column) -> Column:
        return let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top)))))

    def loss(v: Column) -> Column:
        logp = let(norm(v), lambda n: F.transform(v, lambda x: F.when(x > float("-inf"), x - n).otherwise(0.0)))
        soft = F.transform(v, lambda x, k: weight(k))
        return let(soft, lambda w: -total(F.zip_with(w, logp, lambda a, b: a * b)) / total(w))

    return let(level_mask(raw, rack_count, floor_usable), loss)


def supcon(rows: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(batch, loss, anchors) of (batch, item, grp, v): rows meet inside their batch only.

    Anchors have a partner of their group, and their batch a second group. A batch is the
    size of a training batch, so the self join is bounded a row.
    """
    unit = rows.withColumn("v", l2_normalised(F.col("v")))
    a = unit.select("batch", F.col("item").alias("i"), F.col("grp").alias("gi"), F.col("v").alias("vi"))
    b = unit.select("batch", F.col("item").alias("j"), F.col("grp").alias("gj"), F.col("v").alias("vj"))
    pairs = a.join(b, "batch").where("i <> j").select("batch", "i", (F.col("gi") == F.col("gj")).alias("pos"), (dot(F.col("vi"), F.col("vj")) / temperature).alias("x"))
    each = pairs.groupBy("batch", "i").agg(F.max("x").alias("m"), F.collect_list("x").alias("xs"), F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_neg"), F.sum(F.when(F.col("pos"), F.col("x"))).alias("s"))
    lse = F.col("m") + F.log(total(F.transform("xs", lambda x: F.exp(x - F.col("m")))))
    loss = lse - F.col("s") / F.col("n_pos")
    anchor = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return each.groupBy("batch").agg(F.coalesce(F.avg(F.when(anchor, loss)), F.lit(0.0)).alias("loss"), F.count_if(anchor).alias("anchors"))


def arcface(rows: DataFrame, centres: DataFrame, scale: float = 30.0, margin: float = 0.3) -> DataFrame:
    """(item, loss) of (item, grp, v) against class centres (grp, c).

    Every centre takes part in every item's loss. Slices of items meet shards of centres
    by a matrix product; a task returns a maximum, a sum below it and the own class's
    value an item, which are merged by a grouped aggregate: no pairs, no lists.
    """
    cos_m, sin_m, floor, drop = math.cos(margin), math.sin(margin), math.cos(math.pi - margin), math.sin(math.pi - margin) * margin
    shards, slices = (max(1, -(-df.count() // most)) for df, most in ((centres, CENTRES), (rows, ITEMS)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = rows.select(F.col("item").cast("long").alias("item"), F.col("grp").cast("string").alias("grp"), l2_normalised(F.col("v")).alias("v"), part("item", slices).alias("slice"), spread(shards).alias("shard"))
    c = centres.select(F.col("grp").cast("string").alias("grp"), l2_normalised(F.col("c")).alias("c"), part("grp", shards).alias("shard")).select("*", spread(slices).alias("slice"))

    def score(items: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        if not len(items) or not len(classes):
            return pd.DataFrame({"item": [], "m": [], "s": [], "t": []})
        cos = np.clip(np.stack(items.v.to_list()) @ np.stack(classes.c.to_list()).T, -1 + 1e-7, 1 - 1e-7)
        own = items.grp.to_numpy()[:, None] == classes.grp.to_numpy()[None, :]
        phi = np.where(cos > floor, cos * cos_m - np.sqrt(1 - cos * cos) * sin_m, cos - drop)
        x = scale * np.where(own, phi, cos)
        top = x.max(axis=1)
        target = np.where(own.any(axis=1), np.where(own, x, -np.inf).max(axis=1), np.nan)
        return pd.DataFrame({"item": items["item"].to_numpy(), "m": top, "s": np.exp(x - top[:, None]).sum(axis=1), "t": target})

    each = q.groupBy("slice", "shard").cogroup(c.groupBy("slice", "shard")).applyInPandas(score, "item long, m double, s double, t double")
    each = each.withColumn("t", F.nanvl("t", F.lit(None).cast("double")))
    tops = each.groupBy("item").agg(F.max("m").alias("top"), F.collect_list(F.struct("m", "s")).alias("parts"), F.max("t").alias("t"))  # one entry a shard of centres
    return tops.select("item", (F.col("top") + F.log(F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["s"] * F.exp(p["m"] - F.col("top")))) - F.col("t")).alias("loss"))


def batch_parts(rows: DataFrame, value: Column, valid: Column) -> DataFrame:
    """(batch, mean, n): the loss of each batch and its effective count."""
    return rows.groupBy("batch").agg(masked_mean(value, valid).alias("mean"), F.count_if(valid).alias("n"))


def combine_batches(parts: DataFrame) -> DataFrame:
    """One row: the effective-count-weighted mean of batch means."""
    return parts.agg((F.sum(F.col("mean") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("loss"), F.sum("n").alias("n"))


def weighted_total(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    return sum((F.lit(float(weights.get(t, 0.0))) * c for t, c in terms.items()), F.lit(0.0))


LOSS_TERMS = ("is_oven", "proj", "food", "container", "accessory", "rack")


def batch_losses(rows: DataFrame, weights: dict[str, float], containers: Sequence[str], accessories: Sequence[str], temperature: float = 0.1, smoothing: float = 0.0) -> DataFrame:
    """(batch, one column a term, total): the six losses of every batch and their weighted sum.

    ``rows`` has batch, item, is_oven, food_exist, container, accessory, rack_level (null if
    unknown), device_known, cavity_group, rack_count, floor_usable, v and the logits
    is_oven_logit, food_logit, container_logit, accessory_logit, raw. Every term is a mean
    over the batch's rows that its label is known of, and 0 without any; devices count for
    proj and rack only where they are known.
    """

    def several(logits: str, names: Sequence[str], label: str) -> Column:
        targets = F.array(*[F.coalesce(F.array_contains(label, n), F.lit(False)).cast("double") for n in names])
        each = F.zip_with(logits, targets, lambda z, t: bce(z, t))
        return F.when(F.col(label).isNotNull(), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / max(1, len(names)))

    device = F.col("device_known")
    level = F.when(device & F.col("rack_level").isNotNull(), level_cross_entropy(F.col("raw"), F.col("rack_level"), F.col("rack_count"), F.col("floor_usable"), smoothing))
    terms = {
        "is_oven": bce(F.col("is_oven_logit"), F.col("is_oven").cast("double")), "food": bce(F.col("food_logit"), F.col("food_exist").cast("double")),
        "container": several("container_logit", containers, "container"), "accessory": several("accessory_logit", accessories, "accessory"), "rack": level,
    }
    means = rows.groupBy("batch").agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(t) for t, x in terms.items()])
    proj = supcon(rows.where(device).select("batch", "item", F.col("cavity_group").alias("grp"), "v"), temperature).select("batch", F.col("loss").alias("proj"))
    both = means.join(proj, "batch", "left").withColumn("proj", F.coalesce("proj", F.lit(0.0)))
    return both.select("batch", *LOSS_TERMS, weighted_total({t: F.col(t) for t in LOSS_TERMS}, weights).alias("total"))
