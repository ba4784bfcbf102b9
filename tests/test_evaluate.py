import pytest

from tarnwork.operators import evaluate
from tarnwork.sources.profile import PROFILE, EvalConfig

ROWS = (
    "item int, is_oven boolean, is_oven_prob double, food_exist boolean, food_prob double, container array<string>, container_prob array<double>, accessory array<string>, "
    "accessory_prob array<double>, rack_level int, raw array<double>, rack_count int, floor_usable boolean, device_known boolean"
)


def frame(spark):
    rows = [
        (1, True, 0.9, True, 0.8, ["glass"], [0.9, 0.2], ["tray"], [0.9, 0.1], 1, [0.0, 5.0, 0.0], 2, True, True),
        (2, True, 0.8, False, 0.3, [], [0.3, 0.1], None, [0.2, 0.1], 2, [0.0, 5.0, 0.0], 2, True, True),
        (3, False, 0.2, None, 0.9, None, [0.9, 0.9], [], [0.4, 0.2], None, [1.0, 0.0, 0.0], None, None, False),
        (4, True, 0.4, True, 0.6, ["metal"], [0.4, 0.7], ["grill"], [0.1, 0.8], None, [1.0, 0.0, 0.0], None, None, False),
    ]
    return spark.createDataFrame(rows, ROWS)


def test_evaluate(spark):
    facts = spark.createDataFrame([(1, "A", "A", False, 0.9, True, True, False), (2, "B", "未知型号", True, 0.2, False, False, True)], "q_id int, true_model string, matched string, external boolean, top1_sim double, inside boolean, correct boolean, rejected boolean")
    cascade = spark.createDataFrame([(True, True), (False, False)], "device_ok boolean, rack_ok boolean")
    got = {r["metric"]: r["value"] for r in evaluate.evaluate(frame(spark), facts, cascade, ("glass", "metal"), ("tray", "grill")).collect()}
    assert got["is_oven_recall"] == pytest.approx(2 / 3) and got["food_f1"] == 1.0 and got["container_map"] == 1.0
    assert (got["rack_acc"], got["rack_acc_pm1"], got["device_top1"], got["external_reject_rate"], got["external_false_accept_rate"]) == (0.5, 1.0, 1.0, 1.0, 0.0)
    assert got["rack_acc_e2e"] == 0.5 and got["rack_err_given_device_err"] == 1.0 and got["accessory_out_oven_map"] is None


def test_calibrate(spark):
    q = spark.createDataFrame([(10, [0.8, 0.6], "GA", False), (11, [0.0, 1.0], "GX", True)], "q_id long, v array<double>, cavity_group string, external boolean")
    refs = spark.createDataFrame([(1, "A", "GA", [1.0, 0.0])], "ref_id long, model string, cavity_group string, v array<double>")
    args = (("glass", "metal"), ("tray", "grill"), ("metal",))
    got = {r["name"]: (r["threshold"], r["source"]) for r in evaluate.calibrate(frame(spark), q, refs, *args).collect()}
    assert got["tau"] == (pytest.approx(0.4), "external")
    assert got["food"] == (pytest.approx(0.45), "max_f1") and got["container/metal"] == (0.5, "recall_target") and got["is_oven"][1] == "max_f1"
    assert {"accessory/tray", "accessory/grill"} < set(got) and len(got) == 8
    assert got["rack_conf"][1] == "default(target_unreachable)"
    alone = evaluate.calibrate(frame(spark), q.where("NOT external"), refs, *args).where("name = 'tau'").first()
    assert (alone["threshold"], alone["source"]) == (0.5, "default")


def test_config_is_checked():
    for bad in ({"tau": 2.0}, {"knn_k": 0}, {"knn_k": True}, {"default_threshold": -0.1}):
        with pytest.raises(ValueError):
            EvalConfig(**bad)


def test_preflight(spark):
    prof = spark.createDataFrame([("A", 2, True, "G1", None), ("B", 2, True, "G2", None)], PROFILE)
    rows = [("train", True, "A", True, [], [], 1), ("train", True, "B", False, [], [], None), ("train", False, None, True, [], [], None), ("val", True, "A", True, [], [], 9)]
    labels = spark.createDataFrame(rows, "split string, is_oven boolean, device_model string, food_exist boolean, container array<string>, accessory array<string>, rack_level int")
    files = spark.createDataFrame([(1, "x", "train"), (2, "x", "val"), (3, "y", "val")], "id int, body string, split string")
    got = {r["check"]: (r["n"], r["ok"]) for r in evaluate.preflight(labels, prof, files, "id", "body").collect()}
    assert got == {"label_errors": (1, False), "leaked_contents": (1, False), "train_groups": (2, True), "oven_kinds": (2, True), "food_values": (2, True), "models_unseen_in_train": (0, True)}
