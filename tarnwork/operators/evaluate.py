"""Whole evaluations, calibrations and preflight checks, each as one long table.

``rows`` has item, is_oven, is_oven_prob, food_exist, food_prob, container,
container_prob, accessory, accessory_prob, rack_level, raw, rack_count, floor_usable,
device_known; unknown labels are null and take part in nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import calibration, metrics, retrieval, rules, split
from tarnwork.operators.batches import loader_faults
from tarnwork.sources.profile import EvalConfig
from tarnwork.sources.scratch import stored


def _classes(task: str, names: Sequence[str], known: Column, scores: Column, labels: Column) -> list[Column]:
    return [_score(f"{task}/{n}", F.get(scores, F.lit(i)), F.when(known, F.array_contains(labels, n))) for i, n in enumerate(names)]


def _score(cls: str, score: Column, target: Column) -> Column:
    return F.struct(F.lit(cls).alias("cls"), score.alias("score"), target.alias("target"))


def task_scores(rows: DataFrame, containers: Sequence[str], accessories: Sequence[str]) -> DataFrame:
    """(cls, score, target) of every known label; accessories also by where they lie."""
    oven = F.col("is_oven")
    made = [_score("is_oven", F.col("is_oven_prob"), oven), _score("food", F.col("food_prob"), F.col("food_exist"))]
    made += _classes("container", containers, F.col("container").isNotNull(), F.col("container_prob"), F.col("container"))
    for task, where in (("accessory", F.lit(True)), ("accessory_in_oven", oven), ("accessory_out_oven", ~oven)):
        made += _classes(task, accessories, F.col("accessory").isNotNull() & where, F.col("accessory_prob"), F.col("accessory"))
    return rows.select(F.inline(F.array(*made))).where("target IS NOT NULL")


def known_levels(rows: DataFrame) -> DataFrame:
    """Masked predictions of the rows whose device and level are known."""
    return metrics.masked_levels(rows.where("device_known AND rack_level IS NOT NULL").withColumn("level", F.col("rack_level")))


def _long(row: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = [F.struct(F.lit(to).alias("metric"), F.col(c).cast("double").alias("value")) for c, to in names.items()]
    return row.select(F.inline(F.array(*pairs)))


def _at_thresholds(scores: DataFrame, thresholds: DataFrame | None, default: float) -> DataFrame:
    """``scores`` with the threshold of each class; an accessory's is the same wherever it lies."""
    if thresholds is None:
        return scores.withColumn("threshold", F.lit(default))
    known = F.broadcast(thresholds.select(F.col("name").alias("__name"), F.col("threshold")))  # one row a class
    name = F.regexp_replace("cls", "^accessory_(in|out)_oven/", "accessory/")
    return scores.join(known, name == F.col("__name"), "left").withColumn("threshold", F.coalesce("threshold", F.lit(default))).drop("__name")


_DEVICE = {"top1": "device_top1", "unknown_rate": "device_unknown_rate", "external_reject_rate": "external_reject_rate", "external_false_accept_rate": "external_false_accept_rate"}


def evaluate(
    rows: DataFrame, facts: DataFrame, cascade: DataFrame, containers: Sequence[str], accessories: Sequence[str], config: EvalConfig = EvalConfig(),  # noqa: B008
    thresholds: DataFrame | None = None, safety: Sequence[str] = (), others: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """(metric, value): task metrics, rack metrics, retrieval and cascade; null if undefined.

    ``thresholds`` (name, threshold) is what :func:`calibrate` returns; without it every
    class takes the default. ``facts`` are those of the gallery's feature, ``others`` those
    of further features by name, all of oven rows; their metrics end in the name.
    """
    scores = stored(_at_thresholds(task_scores(rows, containers, accessories), thresholds, config.default_threshold), "task-scores")
    report = stored(metrics.multilabel_report(scores, F.col("threshold"), ("acc",)), "task-report")
    flat = report.where("cls IN ('is_oven', 'food')").select(F.inline(F.array(*[F.struct(F.concat(F.col("cls"), F.lit(f"_{m}")).alias("metric"), F.col(m).alias("value")) for m in ("acc", "precision", "recall", "f1")])))
    task = F.substring_index("cls", "/", 1)
    maps = report.where("cls LIKE '%/%'").groupBy(F.concat(task, F.lit("_map")).alias("metric")).agg(F.avg("ap").alias("value"))
    safe = report.where(F.col("cls").isin(*[f"container/{n}" for n in safety])).select(F.concat(F.lit("safety_recall/"), F.substring_index("cls", "/", -1)).alias("metric"), F.col("recall").alias("value"))
    rack_conf = config.default_threshold
    if thresholds is not None:
        one = thresholds.where("name = 'rack_conf'").select("threshold").take(1)
        rack_conf = one[0]["threshold"] if one else rack_conf
    rack = _long(metrics.rack_report(known_levels(rows), rack_conf), {"acc": "rack_acc", "acc_pm1": "rack_acc_pm1", "floor_acc": "rack_floor_acc", "mean_conf": "rack_mean_conf", "low_conf_rate": "rack_low_conf_rate"})
    ends = _long(metrics.cascade_report(cascade), {"rack_acc_e2e": "rack_acc_e2e", "rack_err_given_device_err": "rack_err_given_device_err"})
    out = flat
    for part in (maps, safe, rack, _long(retrieval.retrieval_report(facts), _DEVICE), ends):
        out = out.unionByName(part)
    for name, more in (others or {}).items():
        out = out.unionByName(_long(retrieval.retrieval_report(more), {c: f"{m}_{name}" for c, m in _DEVICE.items()}))
    return out


def default_calibration(spark: SparkSession, containers: Sequence[str], accessories: Sequence[str], config: EvalConfig = EvalConfig()) -> DataFrame:  # noqa: B008
    """(name, threshold, source) before any calibration."""
    names = ["is_oven", "food", *(f"container/{n}" for n in containers), *(f"accessory/{n}" for n in accessories), "rack_conf"]
    rows = [(n, float(config.default_threshold), "default") for n in names] + [("tau", float(config.tau), "default")]
    return spark.createDataFrame(rows, "name string, threshold double, source string")


def calibrate(rows: DataFrame, queries: DataFrame, refs: DataFrame, containers: Sequence[str], accessories: Sequence[str], safety: Sequence[str] = (), config: EvalConfig = EvalConfig()) -> DataFrame:  # noqa: B008
    """(name, threshold, source): every threshold of the decision chain.

    Safety classes take the recall target, others the best F1; rack confidence the
    precision target; tau real externals if there are any, else one group left out, else
    the default.
    """
    scores = stored(task_scores(rows, containers, accessories).where(~F.col("cls").startswith("accessory_")), "task-scores")
    safe = F.col("cls").isin(*[f"container/{n}" for n in safety])
    default = config.default_threshold
    best = calibration.best_f1_threshold(scores.where(~safe), default, ["cls"]).withColumnRenamed("cls", "name")
    wanted = calibration.recall_target_threshold(scores.where(safe), config.safety_recall_target, default, ["cls"]).withColumnRenamed("cls", "name")
    levels = known_levels(rows).select(F.col("conf").alias("score"), (F.col("pred") == F.col("level")).alias("target"))
    rack = calibration.precision_target_threshold(levels, config.rack_target_precision, default).withColumn("name", F.lit("rack_conf"))
    tau = rows.sparkSession.createDataFrame([(float(config.tau), "default")], "threshold double, source string")
    for scored, how in zip(calibration.tau_scores(queries, refs), ("external", "gallery_loo"), strict=True):  # the second search only if the first gives no tau
        found = calibration.choose_tau(scored).select("tau").take(1)
        if found:
            tau = rows.sparkSession.createDataFrame([(found[0]["tau"], how)], "threshold double, source string")
            break
    tau = tau.select(F.lit("tau").alias("name"), "threshold", "source")
    return best.unionByName(wanted).unionByName(rack).unionByName(tau)


def preflight(labels: DataFrame, profile: DataFrame, files: DataFrame, ident: str, content: str) -> DataFrame:
    """(check, n, ok): what must hold before training.

    ``labels`` and ``files`` have ``split``. Failures are counted, none ends the report.
    """
    log = rules.issue_log(rules.check_labels(labels, profile), "split")
    errors = log.agg(F.count_if(F.col("level") == "error").alias("n")).select(F.lit("label_errors").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    leaks = split.split_leakage(files, ident, content).agg(F.count("*").alias("n")).select(F.lit("leaked_contents").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    known = rules.with_profile(labels, profile).where("split = 'train' AND is_oven AND in_profile")
    groups = known.agg(F.count_distinct("cavity_group").alias("n")).select(F.lit("train_groups").alias("check"), "n", (F.col("n") >= 2).alias("ok"))
    kinds = labels.where("split = 'train'").agg(F.count_distinct("is_oven").alias("n")).select(F.lit("oven_kinds").alias("check"), "n", (F.col("n") == 2).alias("ok"))
    foods = labels.where("split = 'train'").agg(F.count_distinct("food_exist").alias("n")).select(F.lit("food_values").alias("check"), "n", (F.col("n") == 2).alias("ok"))
    unseen = rules.unseen(labels.where("split = 'train'"), labels.where("split = 'val'"), "device_model").agg(F.count("*").alias("n")).select(F.lit("models_unseen_in_train").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    out = errors
    for part in (leaks, groups, kinds, foods, unseen):
        out = out.unionByName(part)
    return out


def loader_checks(report: DataFrame) -> DataFrame:
    """(check, n, ok) of the first batches, as :func:`tarnwork.operators.batches.checked` reports them: any fault fails, and so does a loader without batches."""
    kinds = ("no_batches", "shape", "not_finite", "size")
    found = loader_faults(report).groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("fault") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
    return found.select(F.inline(F.array(*[F.struct(F.lit(f"loader_{k}").alias("check"), F.col(k).alias("n"), (F.col(k) == 0).alias("ok")) for k in kinds])))


def verdict(*checks: DataFrame) -> DataFrame:
    """One row (status, failed) of all (check, n, ok): passed if every check holds, else failed with their names in order."""
    every = checks[0].select("check", "ok")
    for more in checks[1:]:
        every = every.unionByName(more.select("check", "ok"))
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check"))))
    return every.agg(failed.alias("failed")).select(F.when(F.size("failed") == 0, "passed").otherwise("failed").alias("status"), "failed")


def preflight_counts(encoded: DataFrame) -> DataFrame:
    """(split, field, value, n): valid labels of every task and rows of every group, by split.

    ``encoded`` is :func:`tarnwork.operators.encode.encode` of labels with ``split``.
    """
    tasks = {"is_oven": F.lit(True), "proj": F.col("group_id") >= 0, "food": F.col("food_known"), "container": F.col("container_known"), "accessory": F.col("accessory_known"), "rack": F.col("rack_known")}
    each = [F.struct(F.lit("task").alias("field"), F.lit(t).alias("value")) for t in tasks]
    held = F.array(*[F.when(when, s) for when, s in zip(tasks.values(), each, strict=True)], F.struct(F.lit("group").alias("field"), F.col("group_id").cast("string").alias("value")))
    return encoded.select("split", F.inline(F.array_compact(held))).groupBy("split", "field", "value").agg(F.count("*").alias("n"))
