import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import calibration, metrics

SCORED = "cls string, score double, target boolean"


def numpy_ap(rows):
    pos = sum(t for _, t in rows)
    if not pos:
        return None
    ap, last = 0.0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        above = [t for x, t in rows if x >= s]
        ap += (sum(above) / pos - last) * sum(above) / len(above)
        last = sum(above) / pos
    return ap


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = [(c, round(rng.random(), 1 if c == "tied" else 6), rng.random() < 0.3) for c in ("tied", "fine") for _ in range(300)]
    return [*made, ("none", 0.4, False), ("none", 0.9, False), ("all", 0.4, True)]


def test_average_precision_counts_ties_once(spark, rows):
    got = {r["cls"]: r["ap"] for r in metrics.average_precision(spark.createDataFrame(rows, SCORED), ["cls"]).collect()}
    for c in got:
        want = numpy_ap([(s, t) for k, s, t in rows if k == c])
        assert (got[c] is None) if want is None else got[c] == pytest.approx(want)


def test_thresholds_against_numpy(spark, rows):
    df = spark.createDataFrame(rows, SCORED)
    f1 = {r["cls"]: r for r in calibration.best_f1_threshold(df, keys=["cls"]).collect()}
    rec = {r["cls"]: r for r in calibration.recall_target_threshold(df, 0.95, keys=["cls"]).collect()}
    for c in ("tied", "fine"):
        mine = [(s, t) for k, s, t in rows if k == c]
        distinct = sorted({s for s, _ in mine}, reverse=True)
        score = [2 * sum(t for x, t in mine if x >= s) / (sum(x >= s for x, _ in mine) + sum(t for _, t in mine)) for s in distinct]
        k = int(np.argmax(score))
        lower = distinct[k + 1] if k + 1 < len(distinct) else 0.0
        assert f1[c]["threshold"] == pytest.approx((distinct[k] + lower) / 2) and f1[c]["source"] == "max_f1"
        pos = sorted((s for s, t in mine if t), reverse=True)
        assert rec[c]["threshold"] == pytest.approx(min(pos[max(1, int(np.ceil(0.95 * len(pos) - 1e-9))) - 1], 0.5))
    assert f1["none"]["source"] == rec["all"]["source"] == "default"


def test_precision_target(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("a", 0.8, True), ("a", 0.7, False), ("b", 0.9, False)], SCORED)
    got = {r["cls"]: (r["threshold"], r["source"]) for r in calibration.precision_target_threshold(df, 0.95, keys=["cls"]).collect()}
    assert got == {"a": (0.8, "target_precision"), "b": (0.5, "default(target_unreachable)")}


def test_binary_stats_nulls_on_empty_denominators(spark):
    row = metrics.binary_stats(spark.createDataFrame([("a", 0.1, False)], SCORED), F.lit(0.5)).first()
    assert (row["n"], row["acc"], row["precision"], row["recall"], row["f1"]) == (1, 1.0, None, None, None)


def test_multilabel_map_skips_one_class_labels(spark, rows):
    report = metrics.multilabel_report(spark.createDataFrame(rows, SCORED), F.lit(0.5))
    assert {r["cls"] for r in report.where("ap IS NULL").collect()} == {"none", "all"}
    assert metrics.mean_average_precision(report).first()["n_classes"] == 2


def test_weighted_score_skips_missing(spark):
    values = spark.createDataFrame([("a", 0.5), ("b", None)], "metric string, value double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0)], "metric string, weight double")
    assert metrics.weighted_score(values, weights).first()["score"] == 0.5


def test_masked_levels_and_rack_report(spark):
    rows = [("A", 2, False, 2, [10.0, 0.0, 3.0, 12.0]), ("A", 2, False, 1, [0.0] * 4), ("B", 3, True, 0, [5.0, 0.0, 0.0, 0.0])]
    df = metrics.masked_levels(spark.createDataFrame(rows, "model string, rack_count int, floor_usable boolean, level int, raw array<double>"))
    assert [r["pred"] for r in df.collect()] == [2, 1, 0]
    assert df.collect()[1]["conf"] == pytest.approx(0.5)
    row = metrics.rack_report(df, 0.5).first()
    assert (row["n"], row["acc"], row["acc_pm1"], row["floor_acc"]) == (3, 1.0, 1.0, 1.0)
    cells = metrics.rack_confusion(df)
    assert cells.where("model = 'A'").count() == 9 and cells.agg(F.sum("n")).first()[0] == 3
