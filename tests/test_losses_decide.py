import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import decide, losses, report
from tarnwork.sources.profile import PROFILE


def test_bce_and_focal_against_numpy(spark):
    rows = [(-3.0, 1.0), (0.0, 0.0), (40.0, 0.0), (-40.0, 1.0), (2.5, 1.0)]
    df = spark.createDataFrame(rows, "z double, t double").select(losses.bce(F.col("z"), F.col("t"), 2.0).alias("b"), losses.focal(F.col("z"), F.col("t")).alias("f"))
    for (z, t), r in zip(rows, df.collect(), strict=True):
        p = 1 / (1 + math.exp(-z))
        b = 2 * t * np.logaddexp(0, -z) + (1 - t) * np.logaddexp(0, z)
        assert r["b"] == pytest.approx(b)
        pt = p * t + (1 - p) * (1 - t)
        assert r["f"] == pytest.approx((t * np.logaddexp(0, -z) + (1 - t) * np.logaddexp(0, z)) * (1 - pt) ** 2)


@pytest.mark.parametrize("size", [1, 3, 4, 8])
def test_any_batching_gives_the_same_loss(spark, size):
    rows = [(i, 0.1 * i - 0.3, float(i % 2), i % 3 != 0) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, z double, t double, known boolean").withColumn("batch", F.floor(F.col("i") / size))
    got = losses.combine_batches(losses.batch_parts(df, losses.bce(F.col("z"), F.col("t")), F.col("known"))).first()
    want = [t * np.logaddexp(0, -z) + (1 - t) * np.logaddexp(0, z) for _, z, t, k in rows if k]
    assert got["loss"] == pytest.approx(np.mean(want)) and got["n"] == len(want)


def test_no_valid_row_costs_nothing(spark):
    assert spark.range(1).agg(losses.masked_mean(F.lit(1.0), F.lit(False)).alias("x")).first()["x"] == 0.0


def test_supcon_against_numpy(spark):
    rng = np.random.default_rng(3)
    groups = [0, 0, 1, 1, 1, 2]
    v = rng.normal(size=(6, 4))
    rows = [(0, i, g, list(map(float, x))) for i, (g, x) in enumerate(zip(groups, v, strict=True))] + [(1, 9, 5, [1.0, 0.0, 0.0, 0.0]), (1, 10, 5, [0.0, 1.0, 0.0, 0.0])]
    got = {r["batch"]: r for r in losses.supcon(spark.createDataFrame(rows, "batch int, item int, grp int, v array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T / 0.1
    want = []
    for i in range(5):
        others = [j for j in range(6) if j != i]
        lse = np.log(np.exp(s[i, others]).sum())
        want.append(np.mean([lse - s[i, j] for j in others if groups[j] == groups[i]]))
    assert got[0]["loss"] == pytest.approx(np.mean(want)) and got[0]["anchors"] == 5
    assert (got[1]["loss"], got[1]["anchors"]) == (0.0, 0)  # one group only


def test_level_smoothing_stays_on_rails(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 9.0], 1, 2, True), ([1.0, 2.0, 3.0, 9.0], 0, 2, True)], "raw array<double>, level int, n int, floor boolean")
    got = [r[0] for r in df.select(losses.level_cross_entropy(F.col("raw"), F.col("level"), F.col("n"), F.col("floor"), 0.2)).collect()]
    lse = math.log(sum(math.exp(x) for x in (1, 2, 3)))
    assert got[0] == pytest.approx(-(0.8 * (2 - lse) + 0.1 * (3 - lse)) / 0.9)
    assert got[1] == pytest.approx(-(1 - lse))


def test_arcface_margin_raises_the_loss(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.2])], "item int, grp string, v array<double>")
    centres = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "grp string, c array<double>")
    plain, hard = (losses.arcface(rows, centres, 10.0, m).first()["loss"] for m in (0.0, 0.3))
    assert 0 < plain < hard


def test_arcface_over_several_slices_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, i % 7, rng.normal(size=4).tolist()) for i in range(40)], "item int, grp int, v array<double>")
    centres = spark.createDataFrame([(g, rng.normal(size=4).tolist()) for g in range(6)], "grp int, c array<double>")
    whole = {r["item"]: r["loss"] for r in losses.arcface(rows, centres).collect()}
    monkeypatch.setattr(losses, "CENTRES", 2)
    monkeypatch.setattr(losses, "ITEMS", 9)
    parts = {r["item"]: r["loss"] for r in losses.arcface(rows, centres).collect()}
    assert set(whole) == set(parts) == set(range(40)) and all((whole[i] is None) == (i % 7 == 6) for i in whole)  # a class without a centre has no loss
    assert all(parts[i] == pytest.approx(v) for i, v in whole.items() if v is not None)


OUT = "item int, is_oven_prob double, food_prob double, container_prob array<double>, accessory_prob array<double>, raw array<double>, model string, cavity_group string, confidence double, top1_sim double"


def run(spark, rows, **options):
    prof = spark.createDataFrame([("A", 2, False, "GA", ["tray"]), ("B", 3, True, "GB", None)], PROFILE)
    out = decide.decide(spark.createDataFrame(rows, OUT), prof, ("glass", "metal"), ("tray", "grill"), **options)
    return out, {r["item"]: r for r in out.collect()}


def test_decisions(spark):
    raw, zero = [10.0, 0.0, 3.0, 12.0], [0.0] * 4
    rows = [
        (1, 0.9, 0.8, [0.9, 0.1], [0.8, 0.9], raw, "A", "GA", 0.625, 0.9), (2, 0.1, 0.8, [0.9, 0.1], [0.8, 0.9], raw, None, None, None, None),
        (3, 0.9, 0.8, [0.9, 0.1], [0.8, 0.9], raw, "未知型号", None, 0.0, -0.70711), (4, 0.9, 0.1, [0.1, 0.1], [0.1, 0.9], raw, "A", "GA", 1.0, 0.9),
        (5, 0.9, 0.8, [0.1, 0.1], [0.1, 0.1], raw, "A", "GA", 1.0, 0.9), (6, 0.9, 0.8, [0.1, 0.1], [0.9, 0.1], zero, "A", "GA", 1.0, 0.9),
    ]
    out, got = run(spark, rows, rack_threshold=0.6)
    assert (got[1]["device_model"], got[1]["device_score"], got[1]["accessory_type"], got[1]["rack_level"], got[1]["low_confidence"]) == ("A", 0.625, ["tray"], 2, False)
    assert (got[2]["device_model"], got[2]["rack_level"], got[2]["accessory_type"], got[2]["pending_gallery"]) == ("无", None, ["tray", "grill"], None)
    assert (got[3]["device_model"], got[3]["device_score"], got[3]["rack_level"], got[3]["accessory_type"], got[3]["pending_gallery"]) == ("未知型号", -0.7071, None, ["tray", "grill"], True)
    assert (got[4]["rack_level"], got[4]["low_confidence"], got[4]["accessory_type"]) == (None, False, [])
    assert (got[5]["rack_level"], got[5]["low_confidence"]) == (2, True)
    assert (got[6]["rack_level"], got[6]["rack_level_score"], got[6]["low_confidence"]) == (1, 0.5, True)
    assert [r["item"] for r in decide.pending(out).collect()] == [3]
    assert {(r["field"], r["value"]): r["n"] for r in decide.result_summary(out).collect()}[("images", "all")] == 6


def test_given_device(spark):
    _, got = run(spark, [(1, 0.9, 0.8, [0.9, 0.1], [0.8, 0.9], [1.0, 0.0, 0.0, 0.0], None, None, None, None)], device_model="B")
    assert (got[1]["device_model"], got[1]["device_score"], got[1]["rack_level"], got[1]["accessory_type"]) == ("B", 1.0, 0, ["tray", "grill"])
    with pytest.raises(ValueError):
        run(spark, [(1, 0.9, 0.8, [0.9, 0.1], [0.8, 0.9], [1.0], None, None, None, None)], device_model="C")


def test_history_best_and_schedule(spark):
    old = spark.createDataFrame([(1, 1, "a", 0.1), (1, 1, "b", 0.2), (2, 2, "a", 0.3)], "epoch int, seq int, metric string, value double")
    new = spark.createDataFrame([(1, 3, "a", 0.9), (1, 3, "c", None)], "epoch int, seq int, metric string, value double")
    assert {tuple(r) for r in report.upsert_history(old, new).collect()} == {(1, "a", 0.9), (2, "a", 0.3)}
    rows = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 0.9), (3, 0.4, 0.1), (4, 0.5 + 1e-10, 0.95), (5, 0.6, 3.0)], "epoch int, score double, loss double")
    assert [r["is_best"] for r in report.best_epochs(rows).orderBy("epoch").collect()] == [True, True, False, False, True]
    lr = [r["lr"] for r in report.lr_schedule(spark, 20, 4, 1.0, 0.1).orderBy("step").collect()]
    assert lr[0] == 0.25 and lr[3] == lr[4] == 1.0 and min(lr) >= 0.1 and sorted(lr[4:], reverse=True) == lr[4:]


def test_key_alignment(spark):
    need = spark.createDataFrame([("a.w", [2, 2]), ("b", [1])], "key string, shape array<int>")
    have = spark.createDataFrame([("module.a.w", [2, 2]), ("module.b", [3]), ("module.extra", [1]), ("b", [1])], "key string, shape array<int>")
    got = {r["key"]: r["fault"] for r in report.align_keys(need, have, ["", "module."]).collect()}
    assert got == {"a.w": None, "b": "shape"}
