"""Evaluation aggregates: tie-inclusive ranking, binary, multi-label, rack and cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.columns import first_argmax, level_mask, ratio, softmax
from tarnwork.sources.scratch import stored


def blocks(scored: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """A row a distinct score: (keys, score, n, tp) cumulative from the top, and n_all, n_pos.

    ``scored`` has score and target; ``lower`` is the next lower score, null at the end.
    Equal scores are grouped before the running sums, which makes these tie-inclusive.
    The running sums are two-level, so that no task holds all scores: quantiles cut the
    scores into as many ranges as the session has shuffle partitions, a window over the
    range totals gives what lies above, and one inside each range does the rest.
    """
    each = scored.groupBy(*keys, "score").agg(F.count("*").alias("n_here"), F.count_if("target").alias("tp_here"))
    each = stored(each, "scores")  # read three times below, and may come from a search
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(each.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.01))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    each = each.withColumn("part", part)
    every, above = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("part")
    before = lambda c: F.coalesce(F.sum(c).over(above.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = each.groupBy(*keys, "part").agg(F.sum("n_here").alias("pn"), F.sum("tp_here").alias("pt"), F.max("score").alias("top"))
    totals = totals.select(
        *keys, "part", before("pn").alias("n0"), before("pt").alias("t0"), F.lead("top").over(above).alias("next"),
        F.sum("pn").over(every).alias("n_all"), F.sum("pt").over(every).alias("n_pos"),
    )
    inside = W.partitionBy(*keys, "part").orderBy(F.desc("score"))
    run = inside.rowsBetween(W.unboundedPreceding, 0)
    return each.join(totals, [*keys, "part"]).select(
        *keys, "score", "n_here", "tp_here", (F.col("n0") + F.sum("n_here").over(run)).alias("n"), (F.col("t0") + F.sum("tp_here").over(run)).alias("tp"),
        "n_all", "n_pos", F.coalesce(F.lead("score").over(inside), "next").alias("lower"),
    )


def average_precision(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ap, positives, n): null without positives."""
    ap = F.sum(F.col("tp_here") / F.col("n_pos") * F.col("tp") / F.col("n"))
    filled = blocks(scored, keys).withColumn("n_pos", F.expr("nullif(n_pos, 0)"))
    return filled.groupBy(*keys).agg(ap.alias("ap"), F.coalesce(F.max("n_pos"), F.lit(0)).alias("positives"), F.max("n_all").alias("n"))


def binary_stats(scored: DataFrame, threshold: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """n, positives, acc, precision, recall, f1 at ``score >= threshold``."""
    pred, t = F.col("score") >= threshold, F.col("target")
    counts = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(pred & t).alias("tp"), F.count_if(pred & ~t).alias("fp"), F.count_if(~pred & t).alias("fn"), F.count_if(~pred & ~t).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *keys, "n", (tp + fn).alias("positives"), ratio(tp + tn, F.col("n")).alias("acc"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def multilabel_report(scored: DataFrame, threshold: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """A row a class of (cls, score, target): binary stats (and ``more`` of them) and AP where both answers occur."""
    stats = binary_stats(scored, threshold, ["cls"])
    ap = average_precision(scored, ["cls"]).select("cls", F.when((F.col("positives") > 0) & (F.col("positives") < F.col("n")), F.col("ap")).alias("ap"))
    return stats.join(ap, "cls").select("cls", "ap", "precision", "recall", "f1", F.col("positives").alias("support"), (F.col("n") - F.col("positives")).alias("negatives"), *more)


def mean_average_precision(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("ap").alias("map"), F.count("ap").alias("n_classes"))


def weighted_score(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the metrics that are there; (metric, value) and (metric, weight)."""
    both = weights.join(metrics, "metric", "left").where("value IS NOT NULL AND weight > 0")
    return both.agg(ratio(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("score"))


def masked_levels(rows: DataFrame) -> DataFrame:
    """Adds pred and conf from raw logits masked by rack_count and floor_usable."""
    masked = rows.withColumn("__masked", level_mask(F.col("raw"), F.col("rack_count"), F.col("floor_usable")))
    masked = masked.withColumn("__p", softmax(F.col("__masked")))
    return masked.withColumn("pred", first_argmax(F.col("__p"))).withColumn("conf", F.array_max("__p")).drop("__masked", "__p")


def rack_report(rows: DataFrame, conf_threshold: float) -> DataFrame:
    """One row; ``rows`` has level, pred, conf."""
    pred, level = F.col("pred"), F.col("level")
    near = (pred >= 1) & (F.abs(pred - level) <= 1)
    mean = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        F.count("*").alias("n"), mean(pred == level).alias("acc"), F.avg(F.when(level >= 1, near.cast("double"))).alias("acc_pm1"),
        mean((pred == 0) == (level == 0)).alias("floor_acc"), F.avg("conf").alias("mean_conf"), mean(F.col("conf") < conf_threshold).alias("low_conf_rate"),
    )


def rack_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("level")).cast("double")).alias("acc"))


def rack_confusion(rows: DataFrame) -> DataFrame:
    """(model, level, pred, n), every cell of a model's square, zeros included."""
    size = rows.groupBy("model").agg(F.max("rack_count").alias("top"))
    cell = lambda: F.explode(F.sequence(F.lit(0), F.col("top")))
    grid = size.select("model", "top", cell().alias("level")).select("model", "level", cell().alias("pred"))
    counts = rows.groupBy("model", "level", "pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["model", "level", "pred"], "left").select("model", "level", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def cascade_report(rows: DataFrame) -> DataFrame:
    """Error of levels under the *retrieved* device; ``rows`` has device_ok, rack_ok."""
    ok, rack = F.col("device_ok"), F.col("rack_ok")
    return rows.agg(
        F.count("*").alias("n"), F.avg(ok.cast("double")).alias("device_acc"), F.avg(rack.cast("double")).alias("rack_acc_e2e"),
        F.avg(F.when(~ok, (~rack).cast("double"))).alias("rack_err_given_device_err"), F.avg(F.when(ok, (~rack).cast("double"))).alias("rack_err_given_device_ok"),
    )
