"""Labels to targets: multi-hot vectors, known masks, group ids, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.columns import is_external, multi_hot
from tarnwork.operators.rules import with_profile

NON_OVEN, EXTERNAL = -1, -2


def group_index(profile: DataFrame) -> DataFrame:
    """(cavity_group, group_id): position among the sorted groups, a table of the profile's size."""
    return profile.select("cavity_group").distinct().withColumn("group_id", F.row_number().over(W.orderBy("cavity_group")) - 1)


def encode(labels: DataFrame, profile: DataFrame, containers: Sequence[str], accessories: Sequence[str]) -> DataFrame:
    """``labels`` with targets, known masks and group_id."""
    joined = with_profile(labels, profile).join(group_index(profile).withColumnRenamed("group_id", "__g"), "cavity_group", "left")
    external = is_external(F.col("device_model")) & F.col("is_oven")
    known = F.col("is_oven") & F.col("device_model").isNotNull() & ~external & F.col("in_profile")
    return joined.withColumns({
        "device_known": known,
        "group_id": F.when(external, EXTERNAL).when(known, F.col("__g")).otherwise(NON_OVEN),
        "food_known": F.col("food_exist").isNotNull(),
        "container_known": F.col("container").isNotNull(),
        "accessory_known": F.col("accessory").isNotNull(),
        "rack_known": known & F.col("rack_level").isNotNull(),
        "food": F.coalesce(F.col("food_exist").cast("double"), F.lit(0.0)),
        "container_hot": multi_hot(F.col("container"), containers),
        "accessory_hot": multi_hot(F.col("accessory"), accessories),
    }).drop("__g")


def without_groups(encoded: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Drops known devices of the groups; externals and non-ovens stay."""
    return encoded.where(~(F.col("device_known") & F.col("cavity_group").isin(*groups)))


def pos_weight(encoded: DataFrame, hot: str, known: str, most: float) -> DataFrame:
    """(cls, pos, neg, weight): negatives over positives, clipped; 1 if either is missing."""
    each = encoded.where(known).select(F.posexplode(hot).alias("cls", "t")).groupBy("cls").agg(F.sum("t").cast("long").alias("pos"), F.count_if(F.col("t") == 0).alias("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    raw = F.when(both, F.col("neg") / F.greatest("pos", F.lit(1))).otherwise(1.0)
    return each.select("cls", "pos", "neg", F.least(F.greatest(raw, F.lit(1 / most)), F.lit(float(most))).alias("weight"))
