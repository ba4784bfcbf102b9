"""Group-balanced batches: a quota plan on three counts, and the batches as one join."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.operators.split import ranked_within, seeded


@dataclass(frozen=True)
class Quota:
    p: int
    n_oven: int
    n_non_oven: int
    n_unknown: int


def apportion(wanted: dict[str, Fraction], seats: int) -> dict[str, int]:
    """``seats`` in proportion to ``wanted``: whole parts first, what is left by the size of the parts cut off."""
    total = sum(wanted.values())
    if not total:
        return dict.fromkeys(wanted, 0)
    exact = {pool: seats * w / total for pool, w in wanted.items()}
    ranking = sorted(exact, key=lambda pool: exact[pool] // 1 - exact[pool])  # stable: ties keep the pools' order
    left = seats - sum(x // 1 for x in exact.values())
    return {pool: int(x // 1) + (ranking.index(pool) < left) for pool, x in exact.items()}


def plan_quota(n_groups: int, n_non_oven: int, n_unknown: int, batch_size: int = 16, p_groups: int = 4, non_oven_ratio: float = 0.25, unknown_ratio: float = 0.25, supcon: bool = True) -> Quota:
    """Quotas of one batch.

    The two side pools get their share of a batch, less if company ovens would keep fewer
    than two groups of two (contrastive training) or one of two; without company ovens
    they fill the batch, by ratio or else by size.
    """
    sizes = {"non_oven": n_non_oven, "unknown": n_unknown}
    if n_groups + sum(sizes.values()) == 0:
        raise ValueError("nothing to sample from")
    if supcon and min(batch_size // 2, p_groups, n_groups) < 2:
        raise ValueError("contrastive batches need four rows and two groups")
    ratios = {pool: Fraction(r) if sizes[pool] else Fraction(0) for pool, r in zip(sizes, (non_oven_ratio, unknown_ratio), strict=True)}
    side = {pool: Fraction(round(batch_size * float(r))) for pool, r in ratios.items()}
    room = batch_size - (4 if supcon else 2) if n_groups else batch_size
    if not n_groups:
        side = apportion(ratios if any(ratios.values()) else {pool: Fraction(n) for pool, n in sizes.items()}, room)
    elif sum(side.values()) > room:
        side = apportion(side, max(room, 0))
    ovens = batch_size - int(sum(side.values()))
    groups = [p_groups, n_groups] + ([ovens // 2] if supcon else [])
    return Quota(min(groups), ovens, int(side["non_oven"]), int(side["unknown"]))


def pool_counts(encoded: DataFrame) -> tuple[int, int, int]:
    """(groups, non-ovens, externals) of the pools: three numbers. Groups below -2 are refused."""
    row = encoded.agg(F.count_if(F.col("group_id") < -2).alias("bad"), F.count_distinct(F.when(F.col("group_id") >= 0, F.col("group_id"))).alias("g"), F.count_if(F.col("group_id") == -1).alias("n"), F.count_if(F.col("group_id") == -2).alias("u")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows have a group below -2")
    return row["g"], row["n"], row["u"]


def cyclic_draw(pool: DataFrame, ident: str, demand: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """Answers (pool, ordinal) demands by cycles through each pool.

    Position ordinal % n of cycle ordinal // n; every cycle is shuffled anew by a seeded
    hash, so a member comes again only after all others of its pool. Returns demand's
    columns and ``ident``.
    """
    sizes = pool.groupBy("pool").agg(F.count("*").alias("size"))
    asked = demand.join(sizes, "pool").withColumns({"cycle": F.floor(F.col("ordinal") / F.col("size")), "at": F.col("ordinal") % F.col("size")})
    turns = asked.groupBy("pool").agg(F.max("cycle").alias("last"))
    each = pool.join(turns, "pool").select("pool", ident, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("cycle"))
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col("cycle").cast("string"), F.col(ident).cast("string")), 256)
    ranked = ranked_within(each.withColumn("__h", key), ["pool", "cycle"], "__h", ident, "at").withColumn("at", F.col("at") - 1).drop("__h")
    return asked.join(ranked, ["pool", "cycle", "at"]).drop("size", "cycle", "at")


def pk_batches(encoded: DataFrame, ident: str, quota: Quota, n_batches: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(batch, slot, pool, ident): P groups without replacement, then non-ovens, then externals.

    Cycles go on across batches: the ordinal of a slot in its pool is the pool's demand
    in all batches before.
    """
    spark = encoded.sparkSession
    batches = spark.range(n_batches).withColumnRenamed("id", "batch")
    groups = encoded.where("group_id >= 0").select("group_id").distinct()
    drawn = batches.crossJoin(groups)  # batches x groups: a schedule, not data
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col("batch").cast("string"), F.col("group_id").cast("string")), 256)
    drawn = drawn.withColumn("j", F.row_number().over(W.partitionBy("batch").orderBy(order, "group_id")) - 1).where(F.col("j") < quota.p)
    base, extra = divmod(quota.n_oven, quota.p) if quota.p else (0, 0)
    take = F.lit(base) + F.when(F.col("j") < extra, 1).otherwise(0)
    ovens = drawn.select("batch", F.col("group_id").alias("pool"), F.col("j").alias("part"), take.alias("take"))
    fixed = [batches.select("batch", F.lit(pool).alias("pool"), F.lit(part).alias("part"), F.lit(n).alias("take")) for pool, part, n in ((-1, 10**6, quota.n_non_oven), (-2, 10**6 + 1, quota.n_unknown)) if n]
    every = ovens
    for f in fixed:
        every = every.unionByName(f)
    every = every.withColumn("first", F.coalesce(F.sum("take").over(W.partitionBy("pool").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    every = every.withColumn("slot0", F.coalesce(F.sum("take").over(W.partitionBy("batch").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    slots = every.where("take > 0").select("batch", "pool", "first", "slot0", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("take") - 1).cast("long"))).alias("i"))
    demand = slots.select("batch", (F.col("slot0") + F.col("i")).alias("slot"), "pool", (F.col("first") + F.col("i")).alias("ordinal"))
    return cyclic_draw(encoded.select(F.col("group_id").alias("pool"), ident), ident, demand, seed, epoch).select("batch", "slot", "pool", ident)


def sequential_batches(rows: DataFrame, ident: str, batch_size: int, shuffle_seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """Batch numbers in identifier order, or in seeded order.

    Two-level numbering: ranges of the order, then positions inside a range.
    """
    key = seeded(shuffle_seed, ident) if shuffle_seed is not None else F.col(ident)
    keyed = rows.withColumn("__k", key)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if shuffle_seed is None:
        cuts = keyed.approxQuantile(ident, [i / n for i in range(1, n)], 0.01) if n > 1 else []
        part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(ident))) if cuts else F.lit(0)
    else:
        part = F.substring("__k", 1, 2)
    keyed = keyed.withColumn("__part", part)
    sizes = keyed.groupBy("__part").agg(F.count("*").alias("__n"))
    run = W.partitionBy(F.lit(0)).orderBy("__part")
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(F.lit(0))).alias("__all"))
    at = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy("__k", ident)) - 1
    out = keyed.join(sizes, "__part").withColumn("batch", F.floor(at / batch_size))
    if drop_last:
        out = out.where(F.col("batch") < F.floor(F.col("__all") / batch_size))
    return out.drop("__k", "__part", "__before", "__all")
