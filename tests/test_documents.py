"""Documents as rows and back, rules about them, folder evaluation, and orders over whole tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import documents as d
from tarnwork.operators import folder_eval as fe
from tarnwork.operators.numbering import SEGMENT, batched, numbered, ordered_digest


def rows_of(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id STRING, raw STRING")


def test_flattened_reaches_every_depth(spark):
    docs = {"a": '{"x": 1, "y": {"z": [1.5, null, {"k": []}], "a.b": "t\\"u"}}', "b": "[true]", "c": "nope {", "d": "7", "e": None}
    got = {(r["id"], r["path"]): (r["kind"], r["value"]) for r in d.flattened(rows_of(spark, docs), "id").collect()}
    assert got[("a", "x")] == ("int", "1") and got[("a", "y.z[0]")] == ("float", "1.5") and got[("a", "y.z[1]")][0] == "null"
    assert got[("a", "y.z[2].k")] == ("list", "[]") and got[("a", 'y."a.b"')] == ("string", 't"u') and got[("a", "")][0] == "object"
    assert got[("b", "[0]")] == ("bool", "true") and got[("c", "")][0] == got[("e", "")][0] == "broken" and got[("d", "")] == ("int", "7")
    assert len(got) == 9 + 2 + 3


def test_nested_and_back(spark):
    rows = [("r", "a.b.c", 1.5), ("r", "a.b.d", None), ("r", "a.x", 2.0), ("r", 'q"', 3.0), ("s", "only", 1.0)]
    table = spark.createDataFrame(rows, "run STRING, metric STRING, value DOUBLE")
    got = {r["run"]: r["document"] for r in d.nested(table, "run").collect()}
    assert json.loads(got["r"]) == {"a": {"b": {"c": 1.5, "d": None}, "x": 2.0}, 'q"': 3.0} and json.loads(got["s"]) == {"only": 1.0}
    assert got["r"].index('"b"') < got["r"].index('"x"')
    back = d.flattened(d.nested(table, "run").withColumnRenamed("document", "raw"), "run").where("kind NOT IN ('object')")
    assert {(r["run"], r["path"]) for r in back.collect()} == {(a, b if '"' not in b else '"q\\""') for a, b, _ in rows}
    with pytest.raises(Exception, match="used twice"):
        d.nested(spark.createDataFrame([("r", "a", 1.0), ("r", "a.b", 2.0)], table.schema), "run").collect()
    assert d.nested(table.where("false"), "run").count() == 0


RULES = (
    d.Rule("s", "section", choices=("n", "f", "b", "t", "c", "l", "dims", "roots", "note")), d.Rule("s.n", "int", low=1, high=9), d.Rule("s.f", "float", "0.5", low=0, high=1, low_open=True, high_open=True),
    d.Rule("s.b", "bool", "true"), d.Rule("s.t", "str"), d.Rule("s.c", "choice", '"x"', choices=("x", "y")), d.Rule("s.l", "str_list", "[]", never=("bad",), may_be_empty=True),
    d.Rule("s.dims", "int_list", size=2, low=1), d.Rule("s.roots", "texts", '"r"'), d.Rule("s.note", "text"), d.Rule("o", "section", "{}"), d.Rule("o.must", "int"), d.Rule("w", "section", '{"x": 1}'),
)
RELATIONS = (d.Relation("s.l", "within", "all"), d.Relation("s.l", "apart_from", "off"), d.Relation("s.f", "at_most", "s.n"), d.Relation("w", "some_positive"))
GOOD = {"s": {"n": 3, "t": " a ", "dims": [2, 3]}, "o": {"must": 1}}


CASES = [  # a change of the good document, and its faults
    ({}, set()), ({"s.n": True}, {("s.n", "type")}), ({"s.n": 3.0}, {("s.n", "type")}), ({"s.n": 10}, {("s.n", "range")}), ({"s.n": None}, {("s.n", "missing")}), ({"s.n": 9}, set()),
    ({"s.f": "3e-1"}, set()), ({"s.f": "x"}, {("s.f", "type")}), ({"s.f": False}, {("s.f", "type")}), ({"s.f": "inf"}, {("s.f", "not_finite")}), ({"s.f": 0}, {("s.f", "range")}), ({"s.f": 1.0}, {("s.f", "range")}),
    ({"s.b": 1}, set()), ({"s.b": 2}, {("s.b", "type")}), ({"s.b": "true"}, {("s.b", "type")}), ({"s.t": "　"}, {("s.t", "blank")}), ({"s.t": 5}, {("s.t", "type")}),
    ({"s.c": " Y "}, set()), ({"s.c": "z"}, {("s.c", "choice")}), ({"s.c": 4}, {("s.c", "choice")}), ({"s.l": ["a", " a"]}, {("s.l", "repeated")}), ({"s.l": ["bad"]}, {("s.l", "never")}), ({"s.l": [1]}, {("s.l", "type")}), ({"s.l": "a"}, {("s.l", "type")}),
    ({"s.dims": [2]}, {("s.dims", "size")}), ({"s.dims": [2, 0]}, {("s.dims", "range")}), ({"s.dims": [2, 1.5]}, {("s.dims", "type")}), ({"s.roots": []}, {("s.roots", "type")}), ({"s.roots": ["a", " "]}, {("s.roots", "blank")}), ({"s.note": None}, set()), ({"s.note": 1}, {("s.note", "type")}),
    ({"s.more": 1}, {("s", "unknown_key")}), ({"s": None}, {("s", "missing")}), ({"s": [1]}, {("s", "type")}), ({"o": None}, {("o.must", "missing")}), ({"o": 3}, {("o", "type")}),
    ({"s.n": 0, "s.t": "", "o": {}}, {("s.n", "range"), ("s.t", "blank"), ("o.must", "missing"), ("s.f", "at_most")}),
    ({"s.l": ["a", "b"], "all": ["a"]}, {("s.l", "within")}), ({"s.l": ["a"], "off": ["a"]}, {("s.l", "apart_from")}), ({"w": {"x": 0.0}}, {("w", "some_positive")}), ({"w": {"x": 0, "y": 2}}, set()), ({"s.f": 0.9, "s.n": 1}, set()),
]


def changed(change):
    made = json.loads(json.dumps(GOOD))
    for path, value in change.items():
        *above, last = path.split(".")
        at = made
        for key in above:
            at = at[key]
        at[last] = value
    return json.dumps(made)


def test_rules_hold_for_all_documents_at_once(spark):
    docs = {str(i): changed(change) for i, (change, _) in enumerate(CASES)} | {"broken": "{", "list": "[1]"}
    values = d.flattened(rows_of(spark, docs), "id")
    got: dict = {}
    for r in d.faults(values, "id", RULES, RELATIONS).collect():
        got.setdefault(r["id"], set()).add((r["path"], r["fault"]))
    assert got.pop("broken") == {("", "broken")} and got.pop("list") == {("", "type")}
    for i, (change, wanted) in enumerate(CASES):
        assert got.get(str(i), set()) == wanted, change
    full = {(r["path"]): r["value"] for r in d.resolved(values, "id", RULES).where("id = '0'").collect()}
    assert full["s.f"] == "0.5" and full["s.n"] == "3" and full["w"] == '{"x": 1}' and "s.note" not in full


def test_folder_evaluation_from_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    write = lambda name, text: (tmp_path / "a b" / name).write_text(text, encoding="utf-8")
    write("1.json", json.dumps({"annotations": {"device_model": "M", "container_type": ["无"], "accessory_type": ["b", "a"], "rack_level": [2]}}))
    write("2 +%.json", json.dumps({"annotations": {"device_model": None, "container_type": ["纸质容器"], "accessory_type": "a", "rack_level": 2.0}}))
    write("3.json", '{"annotations": ')
    write("4.json", '﻿{"annotations": {}}')
    write("5.json", '{"device_model": "M"}')
    write("6.json", '{"annotations": [1]}')
    (tmp_path / "a b" / "8.json").write_bytes(b'{"annotations": {"device_model": "\xff"}}')
    base = f"file:{tmp_path}/a b"
    rows = [
        (f"{base}/1.jpg", "M", [], ["a", "b"], 2), (f"{base}/1.png", "N", [], ["a", "b"], 2), (f"{base}/2 +%.jpg", None, ["油纸"], ["a"], 2),
        *((f"{base}/{n}.jpg", "M", [], [], 1) for n in (3, 4, 6, 7, 8)), (f"{base}/5.jpg", None, None, None, None),
    ]
    results = spark.createDataFrame(rows, "image STRING, device_model STRING, container_type ARRAY<STRING>, accessory_type ARRAY<STRING>, rack_level INT")
    verdicts = fe.judged(results, fe.truth_values(fe.read_truth(spark, str(tmp_path))))
    got = {r["image"].rpartition("/")[2]: r for r in verdicts.collect()}
    assert [n for n, r in sorted(got.items()) if not r["judged"]] == ["3.jpg", "4.jpg", "6.jpg", "7.jpg", "8.jpg"]
    wrong = {n: [e["field"] for e in r["errors"]] for n, r in got.items() if r["judged"]}
    assert wrong == {"1.jpg": [], "1.png": ["device_model"], "2 +%.jpg": ["accessory_type", "rack_level"], "5.jpg": []}
    table = {r["field"]: (r["ok"], r["total"], r["rate"]) for r in fe.accuracy(verdicts).collect()}
    assert table == {"device_model": (3, 4, 0.75), "container_type": (4, 4, 1.0), "accessory_type": (3, 4, 0.75), "rack_level": (3, 4, 0.75)}
    assert {r["rate"] for r in fe.accuracy(verdicts.where("false")).collect()} == {0.0}


def test_numbers_and_digest_do_not_hang_on_partitions(spark):
    rng = random.Random(1)
    rows = [("k" * rng.randint(0, 3) + str(rng.randint(0, 40)), f"v{i}" if i % 50 else None) for i in range(3000)]
    table = spark.createDataFrame(rows, "k STRING, v STRING")
    got = numbered(table.repartition(7), "k", "v").collect()
    order = sorted(rows, key=lambda r: (r[0].encode(), (r[1] is not None, (r[1] or "").encode())))
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["number"])] == order and {r["number"] for r in got} == set(range(3000))
    assert batched(numbered(table, "k", "v"), 16).where("number = 35").select("batch", "slot").first() == (2, 3)

    digests = {tuple(ordered_digest(table.repartition(n), "k", "v").first()) for n in (1, 64)}
    shown = lambda s: f"{'-' if s is None else len(s.encode())}:{s or ''}"
    level = [hashlib.sha256((shown(k) + shown(v)).encode()).hexdigest() for k, v in order]
    for _ in range(3):
        level = [hashlib.sha256("".join(level[i : i + SEGMENT]).encode()).hexdigest() for i in range(0, len(level), SEGMENT)]
    assert digests == {(3000, hashlib.sha1("".join(level).encode()).hexdigest()[:16])}
    changed = table.withColumn("v", F.when(F.col("v") == "v77", "v78").otherwise(F.col("v")))
    assert ordered_digest(changed, "k", "v").first()["digest"] != next(iter(digests))[1]
    assert ordered_digest(table.where("false"), "k", "v").first()["n"] == 0


CONFIG = {
    "model": {"dino_type": "d", "size": "l"}, "labels": {"container": ["油纸", "烤盘"], "accessory": ["烤架"], "safety_container": ["油纸"]}, "data": {"root": " a "},
    "input": {"img_dim": [448, 768], "mean": [0.5, 0.5, 0.5], "std": [0.2, 0.2, 0.2]}, "loss": {"weights": dict.fromkeys(("is_oven", "proj", "food", "container", "accessory", "rack"), 1.0)},
    "trainparams": {"epochs": 30, "batch_size": 16, "lr": "3e-4"},
}


def test_training_configuration(spark, tmp_path):
    from tarnwork.sources.config import BUNDLE_RULES, CONFIG_RULES, RELATIONS, check_bundle_description, read_config

    assert len(CONFIG_RULES) > 90 and len(BUNDLE_RULES) == 14
    (tmp_path / "good.json").write_text(json.dumps(CONFIG), encoding="utf-8")
    got = read_config(spark, str(tmp_path / "good.json"))
    assert got["trainparams"]["lr"] == 3e-4 and got["data"]["root"] == ["a"] and got["eval"]["tau"] == 0.5 and got["labels"]["none_tokens"] == ["无"] and got["sampler"]["type"] == "pk"

    bad = json.loads(json.dumps(CONFIG))
    bad["labels"] |= {"container": ["无", "b"], "none_tokens": None, "safety_container": ["c"]}
    bad["loss"]["weights"] = dict.fromkeys(bad["loss"]["weights"], 0) | {"other": 0}
    bad["trainparams"] |= {"min_lr": 1, "batch_size": 1, "use_amp": "yes"}
    bad["input"] |= {"img_dim": [1, True], "std": [0, 1, 1], "letterbox": True}
    bad["eval"] = {"tau": 2, "score_weights": {"rack_acc": -1}}
    bad["data"] = {"on_error": "stop"}
    values = d.flattened(rows_of(spark, {"x": json.dumps(bad)}), "id")
    assert {(r["path"], r["fault"]) for r in d.faults(values, "id", CONFIG_RULES, RELATIONS).collect()} == {
        ("labels.none_tokens", "apart_from"), ("labels.safety_container", "within"), ("loss.weights", "some_positive"), ("loss.weights", "unknown_key"), ("trainparams.min_lr", "at_most"), ("trainparams.batch_size", "range"),
        ("trainparams.use_amp", "type"), ("input.img_dim", "type"), ("input.std", "range"), ("input.letterbox", "choice"), ("eval.tau", "range"), ("eval.score_weights.rack_acc", "range"), ("eval.score_weights", "some_positive"),
        ("data.on_error", "choice"), ("data.root", "missing"),
    }

    meta = {
        "fingerprint": "f", "max_rack": 8, "container_classes": ["a"], "accessory_classes": ["b"], "outputs": ["cls", "proj", "rack_raw", "accessory_prob", "container_prob", "food_prob", "is_oven_prob"],
        "input": {"name": "image", "img_dim": [2, 3], "mean": [0, 0, 0], "std": [1, 1, 1], "img_interp": "Area"},
    }
    assert check_bundle_description(spark, meta)["input"]["img_interp"] == "area"
    with pytest.raises(ValueError, match="input.layout: choice; outputs: names"):
        check_bundle_description(spark, meta | {"outputs": ["cls"], "input": meta["input"] | {"layout": "NHWC"}})


def test_documents_are_taken_apart_and_resolved_without_writing_and_with_one_shuffle(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": {"c": [[{"d": 2.0}]]}}}'), (2, "{"), (3, '{"x": "[{[{[{[{[{"}')], "id LONG, raw STRING")
    values = d.flattened(docs, "id")
    assert {(r.id, r.path, r.kind) for r in values.collect()} >= {(1, "a.b.c[0][0].d", "float"), (2, "", "broken"), (3, "x", "string")}
    out = d.resolved(values, "id", [d.Rule("a.b.c[0][0].d", "float"), d.Rule("e", "int", "7")])
    assert sorted((r.id, r.path, r.value) for r in out.collect() if r.path == "e") == [(1, "e", "7"), (2, "e", "7"), (3, "e", "7")]
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(id") == 1  # the documents' own, before they are taken apart
