import json

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import encode, rules
from tarnwork.sources import annotations, profile

BOX, TOOL = ("glass", "metal"), ("tray", "grill")


def parse(spark, *docs):
    rows = [(f"{i}.json", d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    out = annotations.parse(spark.createDataFrame(rows, "json_path string, raw string"), BOX, TOOL)
    return [r.asDict(recursive=True) for r in out.orderBy("json_path").collect()]


def codes(row):
    return sorted(i["code"] for i in row["issues"])


FULL = {"device_model": "A", "is_oven": True, "food_exist": True, "container_type": ["glass"], "accessory_type": [], "rack_level": 1}


def test_four_states(spark):
    missing = {k: v for k, v in FULL.items() if k not in ("food_exist", "container_type")}
    null = FULL | {"food_exist": None, "container_type": None, "accessory_type": None}
    hidden = {k: v for k, v in FULL.items() if k != "food_exist"} | {"food_name": ["遮挡"], "container_type": ["遮挡", "glass"]}
    a, b, c, d = parse(spark, FULL, missing, null, hidden)
    assert (a["food_exist"], a["container"], a["accessory"], a["rack_level"], codes(a)) == (True, ["glass"], [], 1, [])
    assert (b["food_exist"], b["container"], codes(b)) == (None, None, ["missing_field", "missing_field"])
    assert (c["food_exist"], c["container"], c["accessory"], codes(c)) == (False, [], [], [])
    assert (d["food_exist"], d["container"], codes(d)) == (None, None, ["遮挡", "遮挡"])
    assert all(r["valid"] for r in (a, b, c, d))


def test_nested_root_external_and_broken(spark):
    got = parse(spark, {"annotations": FULL}, FULL | {"device_model": " 未知　"}, "{oops", "[]", FULL | {"container_type": 1}, FULL | {"container_type": ["wood"]}, {"annotations": []} | FULL)
    assert got[0]["container"] == ["glass"] and got[1]["device_model"] == "未知"
    assert codes(got[2]) == codes(got[3]) == ["bad_json"] and not got[2]["valid"]
    assert "bad_type" in codes(got[4]) and "unknown_class" in codes(got[5]) and not got[5]["valid"]
    assert got[6]["valid"]


@pytest.mark.parametrize(
    ("value", "level", "bad"),
    [(None, None, 0), (["无"], None, 0), ("无", None, 0), ([], None, 0), (0, 0, 0), ("0", 0, 0), (["2"], 2, 0), (3.0, 3, 0), (["1", "1"], None, 1), (True, None, 1), (-1, None, 1), (1.5, None, 1), ("x", None, 1), ("底板层", None, 1)],
)
def test_rack_level(spark, value, level, bad):
    row = parse(spark, FULL | {"rack_level": value})[0]
    assert row["rack_level"] == level
    assert codes(row).count("bad_rack_level") == bad


def test_names_are_distinct_and_none_with_names_warns(spark):
    row = parse(spark, FULL | {"container_type": [" glass", "无", "glass", "metal"]})[0]
    assert row["container"] == ["glass", "metal"] and codes(row) == ["none_with_names"]


LABEL = "json_path string, is_oven boolean, device_model string, food_exist boolean, container array<string>, accessory array<string>, rack_level int"


def test_rules_and_encoding(spark):
    prof = spark.createDataFrame([("A", 2, False, "G1", ["tray"]), ("B", 3, True, "G2", None)], profile.PROFILE)
    rows = [
        ("ok", True, "A", True, ["glass"], ["tray"], 1), ("range", True, "A", True, [], ["tray"], 3), ("floor", True, "A", True, [], ["grill"], 0), ("ext", True, "未知", True, [], [], 9),
        ("typo", True, "A_", True, [], [], None), ("none", True, None, False, [], [], None), ("off", False, "B", None, None, None, 2), ("empty", True, "B", False, [], [], 1), ("plain", False, None, False, [], [], None),
    ]
    labels = spark.createDataFrame(rows, LABEL)
    got = {r["json_path"]: sorted(i["code"] for i in r["issues"]) for r in rules.check_labels(labels, prof).collect()}
    assert got == {
        "ok": [], "range": ["rack_out_of_range"], "floor": ["accessory_unsupported", "rack_floor_unusable"], "ext": [], "typo": ["rack_missing", "unknown_device"],
        "none": ["missing_device"], "off": ["device_not_oven", "rack_not_oven"], "empty": ["rack_on_empty", "rack_without_accessory"], "plain": [],
    }
    assert rules.valid_labels(rules.check_labels(labels, prof)).count() == 4
    strict = rules.check_labels(labels, prof, rules.STRICT).where("json_path = 'empty'").first()["issues"]
    assert {i["level"] for i in strict} == {"error"}
    enc = {r["json_path"]: r for r in encode.encode(labels, prof, BOX, TOOL).collect()}
    assert [enc[k]["group_id"] for k in ("ok", "empty", "ext", "plain", "typo")] == [0, 1, -2, -1, -1]
    assert enc["ok"]["container_hot"] == [1.0, 0.0] and not enc["ext"]["rack_known"] and enc["off"]["container_known"] is False
    assert rules.unknown_models(labels, prof).collect()[0]["device_model"] == "A_"


def test_pos_weight_is_clipped(spark):
    rows = [([1.0, 0.0, 1.0], True)] * 1 + [([0.0, 0.0, 1.0], True)] * 9 + [([1.0, 1.0, 0.0], False)]
    got = [r["weight"] for r in encode.pos_weight(spark.createDataFrame(rows, "hot array<double>, known boolean"), "hot", "known", 4.0).orderBy("cls").collect()]
    assert got == [4.0, 1.0, 1.0]


def test_profile_checks():
    good = {"_note": "x", "A": {"rack_count": 2, "floor_usable": True, "cavity_group": "G"}, "B": {"rack_count": 2, "floor_usable": True, "cavity_group": "G", "accessories": ["t"]}}
    assert len(profile.profile_rows(good)) == 2
    for bad in ({"A": {"rack_count": True, "floor_usable": True}}, {}, {"A": good["A"], "B": good["B"] | {"rack_count": 3}}, {"A": good["A"] | {"rack_count": 99}}):
        with pytest.raises(ValueError):
            profile.profile_rows(bad)
    with pytest.raises(ValueError):
        profile.profile_rows(good, accessory_classes=["other"])


def test_image_lookup(spark):
    notes = spark.createDataFrame([("/d/a.json", '{"image": "x\\\\b.png"}'), ("/d/c.json", "{}"), ("/d/e.json", "{}")], "json_path string, raw string")
    files = spark.createDataFrame([("/d/b.png",), ("/d/c.png",), ("/d/c.JPG",), ("/d/e.txt",)], "path string")
    got = {r["json_path"]: r["image_path"] for r in annotations.with_image(notes, files).collect()}
    assert got == {"/d/a.json": "/d/b.png", "/d/c.json": "/d/c.png", "/d/e.json": None}


def test_bundle_round_trip(spark, tmp_path):
    refs = spark.range(3)
    profile.write_bundle(refs, str(tmp_path / "b"), "v1")
    assert profile.read_bundle(spark, str(tmp_path / "b"), "v1").count() == 3
    with pytest.raises(ValueError):
        profile.read_bundle(spark, str(tmp_path / "b"), "v2")
    assert profile.fresh_dir(str(tmp_path), "d", "t").name == "d" and profile.fresh_dir(str(tmp_path), "d", "t").name == "d_t" and profile.fresh_dir(str(tmp_path), "d", "t").name == "d_t_1"


def test_profile_defaults_and_faults():
    rows = profile.profile_rows({"A": {"rack_count": 2, "cavity_group": " G "}, "B": {"rack_count": 2, "floor_usable": True, "cavity_group": "G"}, "C": {"rack_count": 1, "floor_usable": False}})
    assert [r[:4] for r in rows] == [("A", 2, True, "G"), ("B", 2, True, "G"), ("C", 1, False, "C")]
    with pytest.raises(ValueError, match="A: not an object; B: rack_count must be 1 to 9"):
        profile.profile_rows({"A": 3, "B": {"rack_count": 0}})


def test_bundle_parts_and_profile(spark, tmp_path):
    refs = spark.createDataFrame([(1, "A", "G1"), (2, "B", "G2")], "ref_id int, model string, cavity_group string")
    path = str(tmp_path / "bundle")
    profile.write_bundle(refs, path, "v1", spark.createDataFrame([("tau", 0.4)], "name string, threshold double"))
    assert profile.read_calibration(spark, path, "v1").first()["threshold"] == 0.4
    fits = spark.createDataFrame([("A", 2, True, "G1", None), ("B", 2, True, "G2", None)], profile.PROFILE)
    assert profile.read_bundle(spark, path, "v1", fits).count() == 2
    with pytest.raises(ValueError, match="B: not_in_profile"):
        profile.read_bundle(spark, path, "v1", fits.where("name = 'A'"))
    with pytest.raises(ValueError, match="model is 'v1'"):
        profile.read_calibration(spark, path, "v2")


def test_a_filter_on_labels_does_not_write_the_parser_out_again_for_each_value(spark):
    docs = spark.createDataFrame([("a", json.dumps(FULL))], "json_path string, raw string").repartition(2)
    out = annotations.parse(docs, BOX, TOOL)
    for rows in (out.where("valid"), out.select(F.inline("issues")), out.where("valid").select("container", "rack_level")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().replace("_", "").count("parsejson") <= 4 and len(plan) < 60_000
