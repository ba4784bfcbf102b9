import json

import pytest

from tarnwork.sources import annotations, generator, profile

BOX, TOOL = ("glass", "metal"), ("tray", "grill")


def run(spark, *docs):
    rows = [(f"{i:03}.json", d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return [r.asDict() for r in generator.normalise(spark.createDataFrame(rows, "json_path string, raw string")).orderBy("json_path").collect()]


def test_rack_levels(spark):
    cases = [
        (None, None), (["无"], None), ("无", None), ([], None), (0, 0), ("0", 0), (["0"], 0), (0.0, 0), ("底板层", 0), (["1", "1"], 1), (["1", 1], 1), (["1", "无"], 1),
        (["1", "错误"], "bad"), (True, "bad"), (-1, "bad"), (1.5, "bad"), ({"a": 1}, "bad"), ([["1"]], "bad"), (["底板层", "1"], "several"),
    ]
    got = run(spark, *({"device_model": "A", "rack_level": v} for v, _ in cases), {"device_model": "A"})
    for (value, want), row in zip(cases, got, strict=False):
        assert row["error"] == ("bad_rack_level" if want == "bad" else None), value
        assert row["rack_level"] == (want if isinstance(want, int) else None), value
        assert (row["multi_rack_level"] is not None) == (want == "several")
    assert json.loads(got[len(cases) - 1]["multi_rack_level"]) == ["底板层", "1"] and got[-1]["rack_level"] is None


def test_devices_foods_and_names(spark):
    got = run(
        spark, {"device_model": " A ", "food_name": ["板栗"], "container_type": [" glass", "无", "glass"]}, {"device_model": "未知型号", "rack_level": "x", "food_name": ["遮挡"]}, {"device_model": None, "food_exist": None},
        {"annotations": {"device_model": "A", "is_oven": None, "food_name": None, "accessory_type": None}}, {"device_model": "未知", "is_oven": False}, {"device_model": "A", "is_oven": False}, {"is_oven": True}, {"device_model": 3},
        {"device_model": "A", "is_oven": 1}, {"device_model": "A", "food_exist": "yes"}, {"device_model": "A", "container_type": [1]}, {"device_model": "A", "accessory_type": {"a": 1}}, "{broken", "[]", {"annotations": []}, {"device_model": "A", "food_name": 5},
    )
    a, ext, none, nested = got[:4]
    assert (a["error"], a["device_model"], a["is_oven"], a["food_exist"], a["container_type"], a["accessory_type"]) == (None, "A", True, True, ["glass"], None)
    assert (ext["error"], ext["device_model"], ext["rack_level"], ext["food_exist"]) == (None, "未知", None, None)
    assert (none["error"], none["is_oven"], none["food_exist"]) == (None, False, False)
    assert (nested["error"], nested["device_model"], nested["food_exist"], nested["accessory_type"]) == (None, "A", False, [])
    assert [r["error"] for r in got[4:]] == ["external_not_oven", "device_not_oven", "oven_without_device", "device_not_text", "oven_not_boolean", "food_not_boolean", "bad_container_type", "bad_accessory_type", "not_an_object", "not_an_object", "annotations_not_an_object", "bad_food_name"]


def test_image_lookup_order(spark):
    notes = [("d/a.json", {"image": "sub/x.png"}), ("d/b.json", {"image": "gone/y.png"}), ("d/c.json", {"annotations": {"image_name": "z.jpg"}}), ("d/e.json", {"image": 5}), ("d/f.json", {"image": "nowhere.png"}), ("d/g.json", {})]
    files = ["d/sub/x.png", "d/x.png", "d/y.png", "d/z.jpg", "d/e.JPG", "d/e.jpg", "d/f.PNG", "d/f.PNG"]
    out = annotations.with_image(spark.createDataFrame([(p, json.dumps(d)) for p, d in notes], "json_path string, raw string"), spark.createDataFrame([(f,) for f in files], "path string"))
    assert {r["json_path"]: r["image_path"] for r in out.collect()} == {"d/a.json": "d/sub/x.png", "d/b.json": "d/y.png", "d/c.json": "d/z.jpg", "d/e.json": "d/e.jpg", "d/f.json": "d/f.PNG", "d/g.json": None}


def test_pairs_get_names_of_their_own(spark):
    good = json.dumps({"device_model": "A"})
    notes = spark.createDataFrame([("r/1/a.json", good), ("r/2/A.json", good), ("r/1/b.json", good), ("r/1/c.json", "{"), ("r/1/d.json", good)], "json_path string, raw string")
    files = spark.createDataFrame([("r/1/a.png",), ("r/2/A.png",), ("r/1/b.png",), ("r/1/c.png",)], "path string")
    got = {r["json_path"]: r["output_stem"] for r in generator.collect_pairs(notes, files, "r/").collect()}
    assert set(got) == {"r/1/a.json", "r/2/A.json", "r/1/b.json"} and got["r/1/b.json"] == "b" and len({s.lower() for s in got.values()}) == 3


def test_load_split(spark, tmp_path):
    folder = tmp_path / "set" / "train"
    folder.mkdir(parents=True)
    full = {"device_model": "A", "is_oven": True, "food_exist": True, "container_type": ["glass"], "accessory_type": ["tray"], "rack_level": 1}
    for name, doc in {"ok": full, "range": full | {"rack_level": 7}, "lost": full, "warn": full | {"accessory_type": []}, "bad": "{"}.items():
        (folder / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False))
        if name != "lost":
            (folder / f"{name}.png").write_bytes(b"x")
    prof = spark.createDataFrame([("A", 2, True, "G1", None)], profile.PROFILE)
    load = lambda **how: annotations.load_split(spark, [f"file://{tmp_path}/set"], "train", prof, BOX, TOOL, **how)
    labels, issues = load(on_error="skip")
    stem = lambda r: r["json_path"].rsplit("/", 1)[1][:-5]
    assert sorted(map(stem, labels.collect())) == ["ok", "warn"] and all(r["image_path"].endswith(".png") for r in labels.collect())
    assert sorted((stem(r), r["level"], r["code"]) for r in issues.collect()) == [("bad", "error", "bad_json"), ("lost", "error", "missing_image"), ("range", "error", "rack_out_of_range"), ("warn", "warning", "rack_without_accessory")]
    assert list(map(stem, load(on_error="skip", strict=True)[0].collect())) == ["ok"]
    with pytest.raises(ValueError, match="3 of 5 annotations"):
        load()
    with pytest.raises(FileNotFoundError):
        annotations.load_split(spark, [f"file://{tmp_path}/set"], "val", prof, BOX, TOOL)
