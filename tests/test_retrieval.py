import math

import pytest

from tarnwork.operators import calibration, retrieval
from tarnwork.operators.vectors import nearest

REFS = "ref_id long, model string, cavity_group string, v array<double>"


def at(sim):
    return [sim, math.sqrt(1 - sim * sim)]


def test_groups_are_voted_before_models(spark):
    refs = spark.createDataFrame([(1, "B", "GB", at(0.9)), (2, "A", "GA", at(0.8)), (3, "A2", "GA", at(0.7))], REFS)
    q = spark.createDataFrame([(100, [1.0, 0.0])], "q_id long, v array<double>")
    row = retrieval.match(q, refs, 3, 0.5).first()
    assert (row["model"], row["cavity_group"]) == ("A", "GA")
    assert row["confidence"] == pytest.approx(0.625)
    assert row["top1_sim"] == pytest.approx(0.9)


def test_rejection_is_strictly_below_tau_and_group_defaults_to_model(spark):
    refs = spark.createDataFrame([(1, "B", None, at(0.5))], REFS)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "q_id long, v array<double>")
    assert {r["cavity_group"] for r in retrieval.match(q.where("q_id = 2"), refs, 1, 0.5).collect()} == {"B"}
    row = retrieval.match(q.where("q_id = 2"), refs, 1, 0.5000001).first()
    assert (row["model"], row["cavity_group"], row["confidence"]) == ("未知型号", None, 0.0)
    assert retrieval.match(q.where("q_id = 1"), refs, 1, 0.5).count() == 0  # a row never finds itself


def test_all_nonpositive_neighbours_give_no_confidence(spark):
    refs = spark.createDataFrame([(5, "A", "GA", [-1.0, 0.0]), (6, "B", "GB", [-1.0, 0.0])], REFS)
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q_id long, v array<double>")
    row = retrieval.match(q, refs, 2, -2.0).first()
    assert (row["model"], row["confidence"]) == ("A", 0.0)


def test_ties_go_to_the_smaller_reference_and_groups_can_be_left_out(spark):
    refs = spark.createDataFrame([(i, "M", "G1" if i < 3 else "G2", [1.0, 0.0]) for i in range(1, 6)], REFS)
    q = spark.createDataFrame([(50, "G1", [2.0, 0.0])], "q_id long, cavity_group string, v array<double>")
    assert [r["ref_id"] for r in nearest(q, refs, 2).orderBy("rank").collect()] == [1, 2]
    assert [r["ref_id"] for r in nearest(q, refs, 2, "cavity_group").orderBy("rank").collect()] == [3, 4]


def test_empty_gallery(spark):
    refs = spark.createDataFrame([], REFS)
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q_id long, v array<double>")
    assert retrieval.match(q, refs).count() == 0


@pytest.mark.parametrize(("s_in", "s_out", "tau"), [([0.8], [0.0], 0.4), ([0.8, 0.8], [0.6, 0.6], 0.7)])
def test_choose_tau(spark, s_in, s_out, tau):
    rows = [(s, True) for s in s_in] + [(s, False) for s in s_out]
    row = calibration.choose_tau(spark.createDataFrame(rows, "s double, inside boolean")).first()
    assert row["tau"] == pytest.approx(tau)
    assert row["balanced_acc"] == 1.0 and row["n_in"] == len(s_in)


def test_choose_tau_needs_both_sides(spark):
    assert calibration.choose_tau(spark.createDataFrame([(0.8, True)], "s double, inside boolean")).count() == 0


def test_bundle_faults(spark):
    refs = spark.createDataFrame([(1, "A", "GA", [1.0]), (2, "X", "GX", [1.0]), (3, "B", "G9", [1.0])], REFS)
    profile = spark.createDataFrame([("A", "GA"), ("B", "GB")], "name string, cavity_group string")
    assert {tuple(r) for r in retrieval.bundle_faults(refs, profile).collect()} == {("X", "not_in_profile"), ("B", "other_group")}


def test_kept_bank_gives_what_a_search_gives_without_a_shuffle_of_the_bank(spark, monkeypatch):
    import random

    from tarnwork.operators import bank as kept
    from tarnwork.operators.vectors import nearest

    monkeypatch.setattr(kept, "BLOCK", 40)
    monkeypatch.setattr(kept, "SLICE", 20)
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, f"g{i % 4}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)], "id LONG, g STRING, v ARRAY<DOUBLE>")
    q, r = rows.withColumnRenamed("id", "q_id"), rows.where("id % 3 <> 0").withColumnRenamed("id", "ref_id")
    held = kept.keep_bank(r, "g")
    assert held.shards == 3
    for exclude in (None, "g"):
        want = sorted(map(tuple, nearest(q, r, 3, exclude).select("q_id", "rank", "ref_id").collect()))
        assert sorted(map(tuple, kept.nearest_kept(q, held, 3, exclude).select("q_id", "rank", "ref_id").collect())) == want
    assert kept.nearest_kept(q.where("false"), held, 3).count() == 0 and kept.nearest_kept(q, kept.keep_bank(r.where("false")), 3).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.nearest_kept(q, held, 3)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning(shard") == 1  # the queries' own


@pytest.mark.parametrize(("copies", "tagged", "k"), [(False, False, 10), (True, False, 10), (False, True, 1), (True, True, 3)])
def test_tiles_find_what_a_whole_matrix_finds_in_little_memory(monkeypatch, copies, tagged, k):
    import tracemalloc

    import numpy as np

    from tarnwork.operators import tiles

    rng = np.random.default_rng(5)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    q, bank = unit(600), unit(40_000)
    if copies:  # a few vectors many times: nearly all similarities are ties
        bank = bank[rng.integers(0, 30, len(bank))]
        q = bank[:600]
    q[3] = np.nan
    q_ids, ref_ids = np.arange(600), rng.permutation(len(bank))
    tags = [np.array([None if x == 3 else f"g{x}" for x in rng.integers(0, 4, n)], object) for n in (len(q), len(bank))]
    tracemalloc.start()
    got = tiles.best(q_ids, q, ref_ids, bank, k, *(tags if tagged else ()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # all similarities of 512 queries alone are 160 MB
    order = np.argsort(ref_ids)
    want = []
    for i in range(len(q)):
        sims = np.round(bank[order] @ q[i], 9)
        sims[q_ids[i]] = -np.inf
        if tagged:
            sims[tags[1][order] == tags[0][i]] = -np.inf
        want += [(i, j) for j in np.argsort(-sims, kind="stable")[:k] if np.isfinite(sims[j])]
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == [(i, int(j)) for i, j in want]


def test_searches_that_nothing_reads_are_left_out(spark, monkeypatch):
    from tarnwork.operators import calibration as c
    from tarnwork.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan("decision_known_device")  # a given device needs no match
    assert plan("decision_mismatches").count("FlatMapCoGroups") == 1
    asked, choose = [], c.choose_tau
    monkeypatch.setattr(c, "choose_tau", lambda scores: asked.append(1) or choose(scores))
    assert [r["source"] for r in QUERIES["calibrate_all"](spark, sf).where("name = 'tau'").collect()] == ["external"]
    assert len(asked) == 1  # there are externals, so no group is left out


def test_small_banks_are_not_scored_whole_and_copies_of_rows_follow_the_cores(monkeypatch):
    import numpy as np

    from tarnwork.operators import tiles, vectors

    rng = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    q, bank, scored, whole = unit(1_000), unit(2_048), [], tiles._whole
    monkeypatch.setattr(tiles, "_whole", lambda *a: scored.append(a[0].shape[0] * a[1].shape[0]) or whole(*a))
    q_ids, ref_ids, sim = tiles.best(np.arange(1_000) + 5_000, q, np.arange(2_048), bank, 3)
    assert sum(scored) <= 0.1 * 1_000 * 2_048
    sims = np.round(q @ bank.T, tiles.DIGITS)
    assert (ref_ids.reshape(-1, 3) == np.argsort(-sims, axis=1, kind="stable")[:, :3]).all() and len(q_ids) == 3_000
    assert vectors._cut(600_000, 480_000, 12) == (19, 8) and vectors._cut(0, 0, 12) == (1, 1)


def test_a_bank_is_cut_into_blocks_of_some_thousands(spark):
    from pyspark.sql import functions as F

    from tarnwork.operators import bank as kept

    rows = spark.range(9_000).select(F.col("id").alias("ref_id"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    held = kept.keep_bank(rows)
    assert held.shards == 2 and held.blocks(spark).select(F.sum(F.size("ref_ids"))).first()[0] == 9_000
