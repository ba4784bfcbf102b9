"""Gallery retrieval with group voting and open-set rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.columns import UNKNOWN_DEVICE, ratio
from tarnwork.operators.vectors import nearest


def with_groups(refs: DataFrame) -> DataFrame:
    """A model without a cavity group is its own group."""
    return refs.withColumn("cavity_group", F.coalesce("cavity_group", "model"))


def gallery(rows: DataFrame) -> DataFrame:
    """(ref_id, model, cavity_group, v) of the rows whose device is known."""
    return with_groups(rows.where("device_known").select("ref_id", "model", "cavity_group", "v"))


def capped(refs: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` references a model, drawn by a seeded hash."""
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("ref_id").cast("string")), 256)
    return refs.withColumn("__n", F.row_number().over(W.partitionBy("model").orderBy(draw, "ref_id"))).where(F.col("__n") <= most).drop("__n")


def vote(neighbours: DataFrame, tau: float) -> DataFrame:
    """(q_id, model, cavity_group, confidence, top1_sim) of (q_id, model, cavity_group, sim, rank).

    Below tau the query is unknown: no group, confidence 0. Similarities count from 0 up.
    Groups are voted first, then the models of the best group; ties go to whichever holds
    the nearest neighbour. All windows share the query's partitioning: one shuffle.
    """
    group, model, query = W.partitionBy("q_id", "cavity_group"), W.partitionBy("q_id", "model"), W.partitionBy("q_id")
    w = F.greatest(F.col("sim"), F.lit(0.0))
    voted = neighbours.select(
        "q_id", "model", "cavity_group", F.max("sim").over(query).alias("top1_sim"),
        F.round(F.sum(w).over(group), 9).alias("gv"), F.min("rank").over(group).alias("gr"),
        F.round(F.sum(w).over(model), 9).alias("mv"), F.min("rank").over(model).alias("mr"),
        F.round(F.sum(w).over(query), 9).alias("all"),
    )
    best = voted.withColumn("__n", F.row_number().over(query.orderBy(F.desc("gv"), "gr", F.desc("mv"), "mr"))).where("__n = 1")
    known = F.col("top1_sim") >= tau
    return best.select(
        "q_id", F.when(known, F.col("model")).otherwise(UNKNOWN_DEVICE).alias("model"), F.when(known, F.col("cavity_group")).alias("cavity_group"),
        F.when(known, F.coalesce(ratio(F.col("gv"), F.col("all")), F.lit(0.0))).otherwise(0.0).alias("confidence"), "top1_sim",
    )


def match(queries: DataFrame, refs: DataFrame, k: int = 10, tau: float = 0.5) -> DataFrame:
    """Vote of the k nearest references of each query; queries without any do not appear."""
    near = nearest(queries, refs, k).join(with_groups(refs).select("ref_id", "model", "cavity_group"), "ref_id")
    return vote(near, tau)


def top1(queries: DataFrame, refs: DataFrame, exclude: str | None = None) -> DataFrame:
    """(q_id, s): similarity of the nearest reference."""
    return nearest(queries, refs, 1, exclude).select("q_id", F.col("sim").alias("s"))


def bundle_faults(refs: DataFrame, profile: DataFrame) -> DataFrame:
    """(model, fault) of gallery models that the profile lacks or groups otherwise."""
    held = with_groups(refs).select("model", F.col("cavity_group").alias("held")).distinct()
    both = held.join(profile.select(F.col("name").alias("model"), "cavity_group"), "model", "left")
    fault = F.when(F.col("cavity_group").isNull(), "not_in_profile").when(F.col("held") != F.col("cavity_group"), "other_group")
    return both.select("model", fault.alias("fault")).where("fault IS NOT NULL")


def retrieval_facts(matches: DataFrame, truth: DataFrame, refs: DataFrame) -> DataFrame:
    """Matches joined with truth (q_id, true_model, true_group, external): flags a query."""
    held = with_groups(refs).select(F.col("cavity_group").alias("true_group"), F.lit(True).alias("held")).distinct()
    both = matches.join(truth, "q_id").join(held, "true_group", "left")
    inside = ~F.col("external") & F.coalesce("held", F.lit(False))
    return both.select(
        "q_id", "true_model", F.col("model").alias("matched"), "external", "top1_sim", inside.alias("inside"),
        F.coalesce(F.col("cavity_group") == F.col("true_group"), F.lit(False)).alias("correct"), F.col("cavity_group").isNull().alias("rejected"),
    )


def retrieval_report(facts: DataFrame) -> DataFrame:
    """One row of rates; a rate over nothing is null."""

    def rate(flag: str, keep: str):
        return F.avg(F.when(F.expr(keep), F.expr(flag).cast("double")))

    return facts.agg(
        F.count("*").alias("n"), rate("correct", "inside").alias("top1"), rate("rejected", "inside").alias("unknown_rate"),
        rate("rejected", "NOT inside").alias("unseen_reject_rate"), F.count_if("external").alias("n_external"),
        rate("rejected", "external").alias("external_reject_rate"), rate("NOT rejected", "external").alias("external_false_accept_rate"),
        F.avg("top1_sim").alias("mean_top1_sim"),
    )


def retrieval_confusion(facts: DataFrame) -> DataFrame:
    return facts.groupBy("true_model", "matched").agg(F.count("*").alias("n"))
