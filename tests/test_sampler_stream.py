"""The endless sampler goes on after a stop, and its batches are those of the static plan."""

from tarnwork.operators.sampling import plan_quota, pk_batches
from tarnwork.streaming.sampler import endless_batches


def test_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    encoded = spark.createDataFrame([(i, i % 3 if i % 5 else -1 - i % 2) for i in range(60)], "id LONG, group_id INT")
    quota = plan_quota(3, 6, 6, batch_size=8, p_groups=2)
    n = 4
    asked = 0

    def ask(*counts):
        nonlocal asked
        for count in counts:  # a file is at most a micro-batch
            spark.createDataFrame([("a", asked + i) for i in range(count)] + [("b", asked + i) for i in range(1)], "consumer STRING, request LONG").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            asked += count
        source = spark.readStream.schema("consumer STRING, request LONG").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        endless_batches(source, encoded, "id", quota, n, str(tmp_path / "out"), str(tmp_path / "cp"), seed=3).awaitTermination(240)

    ask(3)
    ask(2, 4)  # another query, from the checkpoint; one request opens the next epoch
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    taken = sorted({(r["consumer"], r["request"], r["epoch"], r["batch"]) for r in got})
    assert [t[2:] for t in taken if t[0] == "a"] == [(k // n, k % n) for k in range(9)]
    assert [t[2:] for t in taken if t[0] == "b"] == [(0, 0), (0, 1), (0, 2)]
    for epoch in (0, 1, 2):
        plan = {(r["batch"], r["slot"]): (r["pool"], r["id"]) for r in pk_batches(encoded, "id", quota, n, 3, epoch).collect()}
        mine = {(r["batch"], r["slot"]): (r["pool"], r["id"]) for r in got if r["epoch"] == epoch and r["consumer"] == "a"}
        assert mine and all(plan[k] == v for k, v in mine.items()) and len(mine) == 8 * len({b for b, _ in mine})


def test_places_are_made_a_piece_at_a_time(monkeypatch):
    import numpy as np

    from tarnwork.streaming import sampler

    monkeypatch.setattr(sampler, "GIVEN", 4)
    pieces = list(sampler._served("a", np.arange(10), 2, 1, 3, True))
    assert [len(p) for p in pieces] == [4, 4, 2]
    assert [(e, b) for p in pieces for e, b in zip(p["epoch"], p["batch"], strict=True)] == [(2 + k // 3, k % 3) for k in range(1, 11)]
