import collections

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import sampling, split


def test_split_counts(spark):
    ns = {1: (1, 0, 0), 2: (2, 0, 0), 3: (1, 1, 1), 13: (11, 1, 1), 11: (9, 1, 1), 614: (491, 62, 61), 4354: (3483, 436, 435), 4101: (3281, 410, 410)}
    t, v, e = split.split_counts(F.col("n"))
    got = {r[0]: tuple(r[1:]) for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", t, v, e).collect()}
    assert got == ns


def test_groups_never_straddle_and_seed_is_stable(spark):
    rows = [(i, f"g{i // 3}", f"m{(i // 3) % 2}" if i % 7 else "m1") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, grp string, model string")
    got = split.stratified_split(df, "grp", "model", 1)
    assert got.groupBy("grp").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert {r["split"] for r in got.collect()} == set(split.SPLITS) and got.count() == 120
    again = {(r["id"], r["split"]) for r in split.stratified_split(df.repartition(3), "grp", "model", 1).collect()}
    assert again == {(r["id"], r["split"]) for r in got.collect()}


def test_content_groups_leakage_and_stems(spark):
    df = spark.createDataFrame([(1, "aa", "train"), (2, "aa", "val"), (3, "bb", "train"), (4, "ccc", "val")], "id int, text string, split string")
    groups = {r["id"]: r["image_group"] for r in split.content_groups(df, "id", "text").collect()}
    assert groups[1] == groups[2] != groups[3] and groups[4] == "file:4"
    assert [(r["n"], r["n_splits"], r["example"]) for r in split.split_leakage(df, "id", "text").collect()] == [(2, 2, 1)]
    stems = [r["output_stem"] for r in split.unique_stems(spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "id int, stem string"), "id", "stem").orderBy("id").collect()]
    assert len({s.lower() for s in stems}) == 3 and stems[2] == "b" and stems[0].startswith("A_")


@pytest.mark.parametrize(
    ("counts", "options", "want"),
    [
        ((6, 8, 0), {}, (4, 12, 4, 0)), ((6, 8, 0), {"batch_size": 4}, (2, 4, 0, 0)), ((6, 8, 0), {"batch_size": 8, "non_oven_ratio": 0.9}, (2, 4, 4, 0)),
        ((6, 8, 8), {}, (4, 8, 4, 4)), ((6, 8, 8), {"batch_size": 8}, (2, 4, 2, 2)),
    ],
)
def test_quota(counts, options, want):
    q = sampling.plan_quota(*counts, **options)
    assert (q.p, q.n_oven, q.n_non_oven, q.n_unknown) == want


def test_quota_guards():
    for counts, options in (((0, 0, 0), {}), ((1, 5, 0), {}), ((4, 0, 0), {"batch_size": 3}), ((4, 0, 0), {"p_groups": 1})):
        with pytest.raises(ValueError):
            sampling.plan_quota(*counts, **options)
    assert sampling.plan_quota(0, 4, 4, supcon=False).n_oven == 0
    assert sampling.apportion({"a": 1, "b": 1, "c": 2}, 6) == {"a": 2, "b": 1, "c": 3} and sampling.apportion({"a": 0}, 5) == {"a": 0}


def test_groups_below_the_reserved_ones_are_refused(spark):
    with pytest.raises(ValueError, match="1 rows"):
        sampling.pool_counts(spark.createDataFrame([(1,), (-3,)], "group_id int"))


def test_pk_batches_cover_before_they_repeat(spark):
    rows = [(g * 5 + i, g) for g in range(6) for i in range(5)] + [(100 + i, -1) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, group_id int")
    quota = sampling.plan_quota(*sampling.pool_counts(df))
    got = sampling.pk_batches(df, "id", quota, 6, seed=17).orderBy("batch", "slot").collect()
    batches = collections.defaultdict(list)
    for r in got:
        batches[r["batch"]].append(r)
    assert len(batches) == 6 and all(len(x) == 16 for x in batches.values())
    for x in batches.values():
        ovens = collections.Counter(r["pool"] for r in x if r["pool"] >= 0)
        assert len(ovens) == 4 and set(ovens.values()) == {3} and [r["slot"] for r in x] == list(range(16))
    for pool in range(-1, 6):
        drawn = [r["id"] for r in got if r["pool"] == pool]
        size = 8 if pool < 0 else 5
        for i in range(0, len(drawn) - size + 1, size):
            assert len(set(drawn[i : i + size])) == size
    other = sampling.pk_batches(df, "id", quota, 6, seed=18)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in got}


def test_sequential_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(37)], "id int")
    got = {r["id"]: r["batch"] for r in sampling.sequential_batches(df, "id", 10).collect()}
    assert got == {i: i // 10 for i in range(37)}
    assert sampling.sequential_batches(df, "id", 10, shuffle_seed=1, drop_last=True).count() == 30
