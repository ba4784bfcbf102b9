"""Listings, diagnoses, snapshots and run folders from files; decisions by class; batches and folds by brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import batches as bt
from tarnwork.operators import decide, evaluate, folds
from tarnwork.sources import snapshots
from tarnwork.sources.annotations import diagnose, load_split
from tarnwork.sources.listing import list_images
from tarnwork.sources.profile import profile_rows, read_bundle, run_dir, with_provenance, write_bundle

PROFILE = "name STRING, rack_count INT, floor_usable BOOLEAN, cavity_group STRING, accessories ARRAY<STRING>"


def test_listing_is_ordered_over_roots(spark, tmp_path):
    for name in ("a/z.JPG", "a/deep er/b.png", "a/n.txt", "a/x.json", "b/a.webp", "c/only.raw"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    roots = [str(tmp_path / "b"), str(tmp_path / "a"), str(tmp_path / "c/only.raw")]
    got = [(r["number"], r["root"], r["path"].removeprefix(f"file:{tmp_path}/")) for r in list_images(spark, roots).orderBy("number").collect()]
    assert got == [(0, 0, "b/a.webp"), (1, 1, "a/deep er/b.png"), (2, 1, "a/z.JPG"), (3, 2, "c/only.raw")]
    with pytest.raises(FileNotFoundError):
        list_images(spark, [str(tmp_path / "none")])
    with pytest.raises(RuntimeError, match="no image"):
        list_images(spark, [str(tmp_path / "c")])


def test_diagnosis_finds_every_issue_of_a_refused_split(spark, tmp_path):
    profile = spark.createDataFrame(profile_rows({"M": {"rack_count": 2}}), PROFILE)
    good = {"device_model": "M", "is_oven": True, "food_exist": True, "container_type": [], "accessory_type": ["tray"], "rack_level": 1}

    def put(name, note, image=b"i"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.json").write_text(note if isinstance(note, str) else json.dumps(note))
        if image is not None:
            (tmp_path / f"{name}.jpg").write_bytes(image)

    put("train/1", good, b"same")
    put("train/2", "{", None)
    put("train/3 x", good | {"device_model": "Q", "rack_level": None}, b"3")
    put("train/4", good | {"container_type": ["?"]}, None)
    put("val/1", good, b"same")
    with pytest.raises(ValueError, match="3 of 4"):
        load_split(spark, [str(tmp_path)], "train", profile, ["c"], ["tray"])
    for strict in (False, True):
        log = diagnose(spark, [str(tmp_path), str(tmp_path / "more")], ["train", "val", "test"], profile, ["c"], ["tray"], strict)
        got = {(r["split"], r["stage"], r["source"].removeprefix("file:").removeprefix(f"{tmp_path}/"), r["code"]): r["level"] for r in log.collect()}
        wanted = {
            ("train", "labels", "train/2.json", "bad_json"): "error", ("train", "labels", "train/3 x.json", "unknown_device"): "error", ("train", "labels", "train/4.json", "unknown_class"): "error", ("train", "labels", "train/4.json", "missing_image"): "error",
            ("train", "labels", "train/3 x.json", "rack_missing"): "error" if strict else "warning", ("train", "contents", "train/1.jpg", "leaked_content"): "error", ("val", "contents", "val/1.jpg", "leaked_content"): "error",
            **{(s, "listing", f"more/{s}", "missing_folder"): "error" for s in ("train", "val", "test")}, ("test", "listing", "test", "missing_folder"): "error",
        }
        assert got == wanted


def test_snapshots_survive_a_failed_writer(spark, tmp_path):
    path = str(tmp_path / "history")
    values = lambda *rows: spark.createDataFrame(rows, "metric STRING, value DOUBLE")
    assert snapshots.restore(spark, path) is None
    snapshots.record(spark, path, 1, values(("loss", 2.0), ("score", None)))
    snapshots.record(spark, path, 2, values(("loss", 1.0)))
    got = snapshots.record(spark, path, 1, values(("loss", 3.0), ("score", 0.5)))
    wanted = {(1, "loss", 3.0), (1, "score", 0.5), (2, "loss", 1.0)}
    assert {tuple(r) for r in got.collect()} == wanted
    broken = values(("loss", 9.0)).select(F.raise_error(F.lit("stop")).cast("double").alias("x"))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(broken, path)
    assert {tuple(r) for r in snapshots.restore(spark, path).collect()} == wanted
    assert snapshots.record(spark, path, 2, values()).where("epoch = 2").isEmpty()


def test_unfinished_runs_are_told(spark, tmp_path):
    refs = spark.createDataFrame([(1, "M", "M", [1.0])], "ref_id LONG, model STRING, cavity_group STRING, v ARRAY<DOUBLE>")
    write_bundle(refs, str(tmp_path / "whole"), "f")
    assert read_bundle(spark, str(tmp_path / "whole"), "f").count() == 1
    with pytest.raises(FileNotFoundError, match="lacks calibration"):
        read_bundle(spark, str(tmp_path / "whole"), "f", parts=("manifest", "gallery", "calibration"))
    with pytest.raises(FileNotFoundError, match="lacks manifest, gallery"):
        read_bundle(spark, str(tmp_path / "none"), "f")
    with pytest.raises(ValueError, match="version"):
        read_bundle(spark, str(tmp_path / "whole"), "")


def test_verdict_names_what_failed(spark):
    made = lambda *rows: spark.createDataFrame(rows, "check STRING, n LONG, ok BOOLEAN")
    report = spark.createDataFrame([(["size"],), ([],)], "faults ARRAY<STRING>")
    got = evaluate.verdict(made(("b", 1, False), ("a", 0, True)), evaluate.loader_checks(report)).first()
    assert (got["status"], got["failed"]) == ("failed", ["b", "loader_size"])
    assert evaluate.verdict(made(("a", 0, True)), evaluate.loader_checks(report.where("size(faults) = 0"))).first()["status"] == "passed"


def test_run_folders(tmp_path):
    made = [run_dir(str(tmp_path), "t").name for _ in range(3)]
    assert made == ["t", "t_01", "t_02"]
    (tmp_path / "t" / "best.pt").write_bytes(b"x")
    assert run_dir(str(tmp_path), "t", resume=str(tmp_path / "t" / "best.pt")) == (tmp_path / "t").resolve()
    assert run_dir(str(tmp_path), "t", explicit=str(tmp_path / "t_01")) == tmp_path / "t_01"
    for wrong in ({"explicit": str(tmp_path / "t")}, {"resume": str(tmp_path / "none")}, {"resume": str(tmp_path / "t" / "best.pt"), "explicit": str(tmp_path / "t_01")}):
        with pytest.raises((FileExistsError, FileNotFoundError, ValueError)):
            run_dir(str(tmp_path), "t", **wrong)
    assert (tmp_path / "t" / "best.pt").read_bytes() == b"x"


def test_provenance_keeps_all_else(spark):
    raw = '{"image": "old", "note": {"a": [1, null]}, "device_model": null}'
    row = with_provenance(spark.createDataFrame([("/in/a.json", '/in/a "q".JPG', raw, "a", "val")], "json_path STRING, image_path STRING, raw STRING, stem STRING, split STRING"), "/out").first()
    assert json.loads(row["document"]) == {
        "note": {"a": [1, None]}, "device_model": None, "source_json": "/in/a.json", "source_image": '/in/a "q".JPG', "image": "a.jpg", "image_name": "a.jpg", "image_root": "/out/val",
    }
    assert (row["image_name"], row["json_name"], row["raw"]) == ("a.jpg", "a.json", raw)


def test_thresholds_by_class_and_mismatches(spark):
    schema = "item INT, is_oven_prob DOUBLE, food_prob DOUBLE, container_prob ARRAY<DOUBLE>, accessory_prob ARRAY<DOUBLE>, raw ARRAY<DOUBLE>, model STRING, cavity_group STRING, confidence DOUBLE, top1_sim DOUBLE"
    rows = spark.createDataFrame([(1, 0.5, 0.5, [0.5, 0.5], [0.5], [0.0, 1.0, 3.0], "M", "M", 0.9, 0.8), (2, 0.2, 0.1, [0.1, 0.9], [0.1], [0.0, 1.0, 2.0], None, None, None, None)], schema)
    profile = spark.createDataFrame(profile_rows({"M": {"rack_count": 2}}), PROFILE)
    limits = decide.threshold_values(spark.createDataFrame([("is_oven", 0.4), ("food", 0.6), ("container/b", 0.55), ("rack_conf", 0.9), ("tau", None)], "name STRING, threshold DOUBLE"))
    assert "tau" not in limits
    plain = decide.decide(rows, profile, ["a", "b"], ["tray"])
    got = decide.decide(rows, profile, ["a", "b"], ["tray"], thresholds=limits, with_scores=True)
    one = {r["item"]: r for r in got.collect()}[1]
    assert (one["is_oven"], one["food_exist"], one["container_type"], one["accessory_type"], one["low_confidence"]) == (True, False, ["a"], ["tray"], True)
    assert one["scores"]["container"] == {"a": 0.5, "b": 0.5} and one["scores"]["food"] == 0.5
    wrong = decide.mismatches(plain, got.drop("scores").where("item = 1")).orderBy("item", "field").collect()
    assert [(r["item"], r["field"], r["ref"], r["got"], r["first"]) for r in wrong] == [
        (1, "container_type", "a,b", "a", False), (1, "food_exist", "true", "false", True), (1, "low_confidence", "false", "true", False), (2, "item", "2", None, True),
    ]


def test_batches_are_checked(spark):
    rows = [(0, 0, [1.0, 2.0]), (0, 1, [0.0, -1.0]), (1, 0, None), (1, 1, [1.0, 2.0, 3.0]), (2, 0, [math.nan, 5.0])]
    table = spark.createDataFrame(rows, "batch LONG, slot LONG, v ARRAY<DOUBLE>").repartition(3)
    report = bt.checked(bt.collated(table, "v"), "v", 2, 2)
    got = {r["batch"]: r for r in report.collect()}
    assert got[0]["v"] == [[1.0, 2.0], [0.0, -1.0]] and (got[0]["least"], got[0]["most"], got[0]["faults"]) == (-1.0, 2.0, [])
    assert got[1]["faults"] == ["shape", "not_finite"] and got[2]["faults"] == ["not_finite", "size"] and got[2]["most"] == 5.0
    assert {r["fault"]: r["n"] for r in bt.loader_faults(report).collect()} == {"shape": 1, "not_finite": 2, "size": 1}
    assert [tuple(r) for r in bt.loader_faults(report.where("false")).collect()] == [("no_batches", 1)]
    assert bt.first_batches(report, 1).count() == 1


def test_folds_equal_a_gallery_without_each_group(spark):
    rng = random.Random(8)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    refs = [(100 + i, f"m{i % 5}", f"g{i % 3}", vec()) for i in range(30)]
    queries = [(i, f"g{i % 4}", i % 7 == 0, vec()) for i in range(40)]
    r = spark.createDataFrame(refs, "ref_id LONG, model STRING, cavity_group STRING, v ARRAY<DOUBLE>")
    q = spark.createDataFrame(queries, "q_id LONG, cavity_group STRING, external BOOLEAN, v ARRAY<DOUBLE>")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    inside = [x for x in queries if not x[2] and x[1] != "g3"]
    sims = folds.fold_similarities(q, r)
    got = {x["fold"]: x for x in folds.leave_group_out(sims, 0.7).collect()}
    for fold in ("g0", "g1", "g2"):
        best = {x[0]: max(cosine(x[3], y[3]) for y in refs if y[2] != fold) for x in inside}
        ins, outs = [best[x[0]] for x in inside if x[1] != fold], [best[x[0]] for x in inside if x[1] == fold]
        assert (got[fold]["n_in"], got[fold]["n_out"]) == (len(ins), len(outs))
        assert got[fold]["in_accept_rate"] == pytest.approx(sum(s >= 0.7 for s in ins) / len(ins)) and got[fold]["out_reject_rate"] == pytest.approx(sum(s < 0.7 for s in outs) / len(outs))
    assert folds.fold_scores(sims, ["g1"]).where("NOT inside").count() == sum(x[1] == "g1" for x in inside)
    alone = folds.leave_group_out(folds.fold_similarities(q, r.where("cavity_group = 'g0'")), 0.7).first()
    assert alone["out_reject_rate"] == 1.0 and alone["n_in"] == 0 and alone["in_accept_rate"] is None
