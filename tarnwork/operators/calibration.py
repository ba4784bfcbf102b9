"""Threshold searches over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.operators.bank import keep_bank, nearest_kept
from tarnwork.operators.metrics import blocks
from tarnwork.operators.retrieval import with_groups
from tarnwork.sources.scratch import stored


def _one_class(n_pos, n_all):
    return (n_pos == 0) | (n_pos == n_all)


def best_f1_threshold(scored: DataFrame, default: float = 0.5, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, threshold, source): midpoint of the best score and the next lower one, the highest on ties."""
    b = blocks(scored, keys)
    f1 = 2 * F.col("tp") / (F.col("n") + F.col("n_pos"))
    first = b.withColumn("f1", f1).withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("f1"), F.desc("score")))).where("__n = 1")
    none = _one_class(F.col("n_pos"), F.col("n_all"))
    return first.select(*keys, F.when(none, default).otherwise((F.col("score") + F.coalesce("lower", F.lit(0.0))) / 2).alias("threshold"), F.when(none, "default").otherwise("max_f1").alias("source"))


def recall_target_threshold(scored: DataFrame, target: float, default: float = 0.5, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The highest threshold that reaches the recall target, and not above the default."""
    b = blocks(scored, keys)
    needed = F.greatest(F.lit(1), F.ceil(F.lit(target) * F.col("n_pos") - 1e-9))
    reach = F.max(F.when(F.col("tp") >= needed, F.col("score")))
    one = b.groupBy(*keys).agg(reach.alias("s"), F.max("n_pos").alias("n_pos"), F.max("n_all").alias("n_all"))
    none = _one_class(F.col("n_pos"), F.col("n_all"))
    return one.select(*keys, F.when(none, default).otherwise(F.least("s", F.lit(default))).alias("threshold"), F.when(none, "default").otherwise("recall_target").alias("source"))


def precision_target_threshold(scored: DataFrame, target: float, default: float = 0.5, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The lowest score whose cumulative precision meets the target."""
    b = blocks(scored, keys)
    one = b.groupBy(*keys).agg(F.min(F.when(F.col("tp") / F.col("n") >= target, F.col("score"))).alias("s"))
    return one.select(*keys, F.coalesce("s", F.lit(default)).alias("threshold"), F.when(F.col("s").isNull(), "default(target_unreachable)").otherwise("target_precision").alias("source"))


def choose_tau(scores: DataFrame) -> DataFrame:
    """One row: the tau of best balanced accuracy over (s, inside); the lowest on ties.

    Candidates are the midpoints of neighbouring distinct similarities and one beyond
    each end, so both rates are running counts over distinct values, without pairs.
    """
    b = blocks(scores.select(F.col("s").alias("score"), F.col("inside").alias("target")))
    ins, outs = F.col("n_pos"), F.col("n_all") - F.col("n_pos")
    tau = F.coalesce((F.col("score") + F.col("lower")) / 2, F.col("score") - 1e-4)
    candidate = lambda t, acc, rej: F.struct(t.alias("tau"), acc.alias("acc"), rej.alias("rej"), ins.alias("n_in"), outs.alias("n_out"))
    here = candidate(tau, F.col("tp") / ins, 1 - (F.col("n") - F.col("tp")) / outs)
    over = F.when(F.col("n") == F.col("n_here"), candidate(F.col("score") + 1e-4, F.lit(0.0), F.lit(1.0)))  # beyond the highest
    tries = b.where((ins > 0) & (outs > 0)).select(F.inline(F.array_compact(F.array(here, over))))
    best = tries.select("tau", F.round((F.col("acc") + F.col("rej")) / 2, 12).alias("balanced_acc"), F.col("acc").alias("in_accept_rate"), F.col("rej").alias("out_reject_rate"), "n_in", "n_out")
    return best.orderBy(F.desc("balanced_acc"), "tau").limit(1)


def tau_scores(queries: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((s, inside) with real externals, the same by leaving one group out).

    ``queries``: q_id, v, cavity_group, external. One theta search replaces a gallery copy
    a group. All three searches read one kept bank, which is not shuffled again.
    """
    refs = with_groups(refs)
    bank = keep_bank(refs, "cavity_group")
    found = lambda rows, exclude=None: nearest_kept(rows, bank, 1, exclude).select(F.col("sim").alias("s"))
    held = refs.select("cavity_group").distinct()
    inside = queries.where(~F.col("external")).join(held, "cavity_group", "left_semi")
    s_in = stored(found(inside).select("s", F.lit(True).alias("inside")), "tau-inside")  # in both results
    s_ext = found(queries.where("external")).select("s", F.lit(False).alias("inside"))
    s_loo = found(inside, "cavity_group").select("s", F.lit(False).alias("inside"))
    return s_in.unionByName(s_ext), s_in.unionByName(s_loo)
