"""Leaving every cavity group out of the gallery in turn, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.columns import ratio
from tarnwork.operators.bank import keep_bank, nearest_kept
from tarnwork.operators.retrieval import with_groups
from tarnwork.sources.scratch import stored


def fold_similarities(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(q_id, cavity_group, s, best_group, s_other): the nearest reference of each query, its group, and the nearest of any other group.

    In the fold of group g a query meets the gallery without g: it finds ``s_other`` if g is
    ``best_group``, else ``s``. So two searches answer all folds, and no query is copied.
    Externals and queries of groups without a reference are no part of any fold.
    ``s_other`` is null with one group only.
    """
    refs = with_groups(refs)
    inside = queries.where(~F.col("external")).join(refs.select("cavity_group").distinct(), "cavity_group", "left_semi")
    groups = refs.select("ref_id", F.col("cavity_group").alias("best_group"))
    bank = keep_bank(refs, "cavity_group")
    best = stored(nearest_kept(inside, bank, 1).join(groups, "ref_id").select("q_id", F.col("sim").alias("s"), "best_group"), "fold-best")
    again = inside.select("q_id", "v").join(best.select("q_id", F.col("best_group").alias("cavity_group")), "q_id")
    other = nearest_kept(again, bank, 1, exclude="cavity_group").select("q_id", F.col("sim").alias("s_other"))
    return inside.select("q_id", "cavity_group").join(best, "q_id").join(other, "q_id", "left")


def leave_group_out(similarities: DataFrame, tau: float) -> DataFrame:
    """(fold, n_in, n_out, in_accept_rate, out_reject_rate, balanced_acc): one row a group that has queries or is some query's best.

    ``out`` are the fold's own queries, which its gallery should reject; ``in`` are all
    others, which it should accept. A query that finds nothing is rejected.
    """
    s = stored(similarities, "fold-similarities")
    hit = lambda c: F.coalesce(F.col(c) >= tau, F.lit(False)).cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    at_home = F.col("best_group") == F.col("cavity_group")
    own = F.struct(F.col("cavity_group").alias("fold"), one.alias("n_out"), (1 - F.when(at_home, hit("s_other")).otherwise(hit("s"))).alias("rejected"), hit("s").alias("accepted"), none.alias("change"))
    lost = F.when(~at_home, F.struct(F.col("best_group").alias("fold"), none.alias("n_out"), none.alias("rejected"), none.alias("accepted"), (hit("s_other") - hit("s")).alias("change")))
    sums = s.select(F.inline(F.array_compact(F.array(own, lost)))).groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n_out", "rejected", "accepted", "change")])
    every = W.partitionBy(F.lit(0))  # one row a group
    n_in = F.sum("n_out").over(every) - F.col("n_out")
    kept = F.sum("accepted").over(every) - F.col("accepted") + F.col("change")
    rates = sums.select("fold", n_in.alias("n_in"), "n_out", ratio(kept, n_in).alias("in_accept_rate"), ratio(F.col("rejected"), F.col("n_out")).alias("out_reject_rate"))
    return rates.withColumn("balanced_acc", (F.col("in_accept_rate") + F.col("out_reject_rate")) / 2)


def fold_scores(similarities: DataFrame, held: list[str] | None = None) -> DataFrame:
    """(s, inside) of all folds for the choice of tau: what queries find in the whole gallery, and what they find without their group.

    With ``held``, only queries of these groups are asked outside.
    """
    s = stored(similarities, "fold-similarities")
    outside = F.when(F.col("best_group") == F.col("cavity_group"), F.col("s_other")).otherwise(F.col("s"))
    asked = s if held is None else s.where(F.col("cavity_group").isin(*held))
    return s.select("s", F.lit(True).alias("inside")).unionByName(asked.select(outside.alias("s"), F.lit(False).alias("inside")).where("s IS NOT NULL"))
