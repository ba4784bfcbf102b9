"""The decision chain from scores and a retrieval match to one result row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import NOT_OVEN_DEVICE, UNKNOWN_DEVICE, first_argmax, level_mask, score_map, softmax

MOST_CLASSES = 10_000  # thresholds that a decision may have; they become part of its plan


def threshold_values(thresholds: DataFrame) -> dict[str, float]:
    """The table (name, threshold) of a calibration as numbers: one row a class, so never more than the classes."""
    rows = thresholds.select("name", F.col("threshold").cast("double").alias("threshold")).take(MOST_CLASSES + 1)
    if len(rows) > MOST_CLASSES:
        raise ValueError("a calibration has one row a class")
    return {r["name"]: r["threshold"] for r in rows if r["threshold"] is not None}


def named(scores: Column, names: Sequence[str], thresholds: Sequence[float]) -> Column:
    """Names whose score reaches the threshold of their class, in vocabulary order."""
    picked = [F.when(F.get(scores, F.lit(i)) >= t, F.lit(n)) for i, (n, t) in enumerate(zip(names, thresholds, strict=True))]
    return F.array_compact(F.array(*picked))


def unmatched(outputs: DataFrame) -> DataFrame:
    """``outputs`` without a match, as :func:`decide` takes them for a given device, of whose rows it reads none."""
    return outputs.withColumns({"model": F.lit(None).cast("string"), "cavity_group": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "top1_sim": F.lit(None).cast("double")})


def decide(
    rows: DataFrame, profile: DataFrame, containers: Sequence[str], accessories: Sequence[str], *, threshold: float = 0.5, rack_threshold: float = 0.5, device_model: str | None = None,
    thresholds: Mapping[str, float] | None = None, with_scores: bool = False,
) -> DataFrame:
    """``rows``: item, is_oven_prob, food_prob, container_prob, accessory_prob, raw, and of
    the match (null if none) model, cavity_group, confidence, top1_sim.

    In order: not an oven; a given device, else an unknown one, which is pending; the
    device's accessories; an empty cavity has no level; the masked level; low confidence.
    A given device must be in the profile and is ignored for rows that are no oven.
    ``thresholds`` by name, as a calibration names them (is_oven, food, container/<name>,
    accessory/<name>, rack_conf), go before ``threshold`` and ``rack_threshold``.
    ``with_scores`` adds ``scores``: what was held against them, to 4 places.
    """
    limit = lambda name, default=threshold: (thresholds or {}).get(name, default)
    rack_threshold = limit("rack_conf", rack_threshold)
    if device_model is not None and profile.where(F.col("name") == device_model).isEmpty():
        raise ValueError(f"{device_model} is not in the profile")
    oven = F.col("is_oven_prob") >= limit("is_oven")
    matched = F.lit(device_model) if device_model is not None else F.when(F.col("cavity_group").isNotNull(), F.col("model"))
    spec = profile.select(F.col("name").alias("__device"), "rack_count", "floor_usable", F.col("accessories").alias("__supported"))
    base = rows.withColumn("__oven", oven).withColumn("__device", F.when(oven, matched))
    base = base.withColumn("__rejected", oven & F.col("__device").isNull())
    both = base.join(spec, "__device", "left")
    known = F.col("__device").isNotNull()
    accessory = named(F.col("accessory_prob"), accessories, [limit(f"accessory/{n}") for n in accessories])
    accessory = F.when(known & F.col("__supported").isNotNull(), F.array_intersect(accessory, F.col("__supported"))).otherwise(accessory)
    both = both.withColumns({
        "food_exist": F.col("food_prob") >= limit("food"),
        "container_type": named(F.col("container_prob"), containers, [limit(f"container/{n}") for n in containers]),
        "accessory_type": accessory,
    }).withColumn("__p", softmax(level_mask(F.col("raw"), F.col("rack_count"), F.col("floor_usable"))))
    leveled = known & (F.col("food_exist") | (F.size("container_type") > 0) | (F.size("accessory_type") > 0))
    level, score = first_argmax(F.col("__p")), F.array_max("__p")
    device_score = F.lit(1.0) if device_model is not None else F.col("confidence")
    scores = F.struct(
        F.round("is_oven_prob", 4).alias("is_oven"), F.round("food_prob", 4).alias("food"),
        score_map(F.col("container_prob"), containers).alias("container"), score_map(F.col("accessory_prob"), accessories).alias("accessory"),
    )
    return both.select(
        "item", F.col("__oven").alias("is_oven"),
        F.when(~F.col("__oven"), NOT_OVEN_DEVICE).when(F.col("__rejected"), UNKNOWN_DEVICE).otherwise(F.col("__device")).alias("device_model"),
        F.round(F.when(F.col("__rejected"), F.col("top1_sim")).when(known, device_score), 4).alias("device_score"),
        "food_exist", "container_type", "accessory_type",
        F.when(leveled, level).alias("rack_level"), F.round(F.when(leveled, score), 4).alias("rack_level_score"),
        F.coalesce(leveled & ((score < rack_threshold) | ((level >= 1) & (F.size("accessory_type") == 0))), F.lit(False)).alias("low_confidence"),
        F.when(F.col("__rejected"), True).alias("pending_gallery"), *([scores.alias("scores")] if with_scores else []),
    )


# The order in which a result is decided: an earlier field explains later ones.
DECIDED = ("is_oven", "device_model", "pending_gallery", "device_score", "food_exist", "container_type", "accessory_type", "rack_level", "rack_level_score", "low_confidence")


def mismatches(ref: DataFrame, got: DataFrame, tolerance: float = 1e-3, fields: Sequence[str] = DECIDED) -> DataFrame:
    """(item, field, ref, got, first) where two results of an item differ.

    Numbers with a fraction may differ by the tolerance, lists are sets, all else is equal
    or not; an item that one side lacks differs in the field ``item``. ``first`` marks the
    field that was decided first, the cause of the others.
    """
    kinds = dict(ref.dtypes)
    side = lambda df, name: df.select("item", F.struct(*fields).alias(name))
    both = side(ref, "a").join(side(got, "b"), "item", "full")

    def shown(x: Column, kind: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(x)), ",") if kind.startswith("array") else x.cast("string")

    def found(field: str, order: int) -> Column:
        a, b, kind = F.col(f"a.{field}"), F.col(f"b.{field}"), kinds[field]
        same = shown(a, kind).eqNullSafe(shown(b, kind))
        if kind in ("double", "float"):
            same = same | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        return F.when(~same, F.struct(F.lit(order).alias("order"), F.lit(field).alias("field"), shown(a, kind).alias("ref"), shown(b, kind).alias("got")))

    here = lambda side: F.when(F.col(side).isNotNull(), F.col("item").cast("string"))
    lacks = F.struct(F.lit(0).alias("order"), F.lit("item").alias("field"), here("a").alias("ref"), here("b").alias("got"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    each = F.when(whole, F.array_compact(F.array(*[found(f, i) for i, f in enumerate(fields, 1)]))).otherwise(F.array(lacks))
    rows = both.select("item", F.array_min(F.transform(each, lambda x: x["order"])).alias("__least"), F.explode(each).alias("x"))
    return rows.select("item", "x.field", "x.ref", "x.got", (F.col("x.order") == F.col("__least")).alias("first"))


def pending(results: DataFrame) -> DataFrame:
    """Rows for the pool of devices to be added."""
    return results.where("pending_gallery")


def result_summary(results: DataFrame) -> DataFrame:
    """(field, value, n) over all results: images, models, levels, low confidence."""
    parts = F.array(
        F.struct(F.lit("images").alias("field"), F.lit("all").alias("value")),
        F.struct(F.lit("device_model").alias("field"), F.col("device_model").alias("value")),
        F.struct(F.lit("rack_level").alias("field"), F.coalesce(F.col("rack_level").cast("string"), F.lit("none")).alias("value")),
        F.when(F.col("low_confidence"), F.struct(F.lit("low_confidence").alias("field"), F.lit("true").alias("value"))),
    )
    return results.select(F.explode(F.array_compact(parts)).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
