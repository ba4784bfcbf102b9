"""Training configuration and bundle description: read as documents, held against rule tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tarnwork.operators.documents import Relation, Rule, faults, flattened, resolved

# Every path of a training configuration, one a line: path, kind, range, default
# (JSON, after =), choices or keys (after |), elements that are refused (after !). A range is
# written with [ ] for closed and ( ) for open ends. Without a default the path is required.
_CONFIG = """
model section
model.dino_type str
model.size str
model.dino_local_repo str = "third_party/dinov3"
model.weight_path str = "data/model/dinov3_vitl16_pretrain_lvd1689m-8aa4cbdd.pth"
model.max_rack int [1,] = 8
model.attn_pool_heads int [1,] = 8
model.head_hidden_dim int [1,] = 512
model.head_dropout float [0,1) = 0.0
model.proj_hidden_dim int [1,] = 512
model.proj_dim int [1,] = 256
model.use_lora bool = true
model.lora_rank int [1,] = 8
model.lora_last_n_blocks int [0,] = 0
labels section
labels.container str_list
labels.accessory str_list
labels.safety_container str_list? = []
labels.none_tokens str_list? = ["无"] ! 未知, 未知型号
device_profile str = "configs/device_profile.json"
data section
data.root texts
data.train_split str = "train"
data.val_split str = "val"
data.test_split text
data.on_error choice = "raise" | raise, skip
data.strict bool = false
data.exclude_groups str_list? = []
input section
input.img_dim int_list:2 [1,]
input.mean float_list:3
input.std float_list:3 (0,]
input.img_interp choice = "linear" | nearest, linear, area
input.letterbox choice = "false" | false
input.train_aug section = {}
input.train_aug.enabled bool = true
input.train_aug.max_crop_frac float [0,0.5) = 0.05
input.train_aug.hflip_p float [0,1] = 0.5
input.train_aug.color_jitter_p float [0,1] = 0.8
input.train_aug.brightness float [0,1) = 0.3
input.train_aug.contrast float [0,1) = 0.2
input.train_aug.saturation float [0,1] = 0.15
input.train_aug.hue float [0,0.5] = 0.02
sampler section = {}
sampler.type choice = "pk" | pk, random
sampler.p_groups int [1,] = 4
sampler.non_oven_ratio float [0,1) = 0.25
sampler.unknown_oven_ratio float [0,1) = 0.25
loss section
loss.weights section | is_oven, proj, food, container, accessory, rack
loss.weights.is_oven float [0,]
loss.weights.proj float [0,]
loss.weights.food float [0,]
loss.weights.container float [0,]
loss.weights.accessory float [0,]
loss.weights.rack float [0,]
loss.metric choice = "supcon" | supcon, arcface
loss.supcon_temperature float (0,] = 0.1
loss.arcface_scale float (0,] = 30.0
loss.arcface_margin float [0,1.5707963267948966) = 0.3
loss.multilabel choice = "bce" | bce, focal
loss.focal_gamma float [0,] = 2.0
loss.pos_weight choice = "auto" | auto, none
loss.pos_weight_max float [1,] = 10.0
loss.rack_smoothing float [0,1) = 0.0
trainparams section
trainparams.epochs int [1,]
trainparams.batch_size int [2,]
trainparams.steps_per_epoch int [0,] = 0
trainparams.num_workers int [0,] = 4
trainparams.num_workers_eval int [0,] = 2
trainparams.lr float (0,]
trainparams.lr_lora float (0,] = 0.0001
trainparams.weight_decay float [0,] = 0.05
trainparams.min_lr float [0,] = 0.0
trainparams.warmup_steps int [0,] = 0
trainparams.use_amp bool = true
trainparams.grad_clip float = 1.0
trainparams.log_every int [1,] = 10
trainparams.seed int = 42
eval section = {}
eval.gallery_max_per_model int [1,] = 200
eval.gallery_feature choice = "proj" | proj, cls
eval.knn_k int [1,] = 10
eval.tau float [-1,1] = 0.5
eval.default_threshold float (0,1) = 0.5
eval.safety_recall_target float (0,1] = 0.95
eval.rack_target_precision float (0,1] = 0.95
eval.score_weights section = {"rack_acc": 1.0, "accessory_map": 1.0, "container_map": 1.0, "device_top1": 1.0} | is_oven_acc, food_acc, food_f1, container_map, accessory_map, rack_acc, rack_acc_pm1, rack_floor_acc, device_top1
eval.run_test bool = true
eval.run_stage2 bool = true
loo section = {}
loo.epochs int [0,] = 0
loo.holdout_frac float (0,1) = 0.3
loo.min_group_images int [2,] = 4
output section = {}
output.root str = "output/oven"
"""
# What a bundle says of its model's input and outputs.
_BUNDLE = """
fingerprint str
max_rack int [1,]
container_classes str_list
accessory_classes str_list
input section
input.name str
input.batch_size choice = "1" | 1
input.color choice = "RGB" | rgb
input.layout choice = "NCHW" | nchw
input.img_dim int_list:2 [1,]
input.mean float_list:3
input.std float_list:3 (0,]
input.img_interp choice | nearest, linear, area
outputs str_list | is_oven_prob, food_prob, container_prob, accessory_prob, rack_raw, proj, cls
"""

RELATIONS = (
    Relation("labels.safety_container", "within", "labels.container"), Relation("labels.none_tokens", "apart_from", "labels.container"), Relation("labels.none_tokens", "apart_from", "labels.accessory"),
    Relation("trainparams.min_lr", "at_most", "trainparams.lr"), Relation("loss.weights", "some_positive"), Relation("eval.score_weights", "some_positive"),
)
_LINE = re.compile(r"(\S+) ([a-z_]+)(\?)?(?::(\d+))?(?: ([\[(])([^,\])]*),([^\])]*)([\])]))?(?: = (.*?))?(?: \| (.*?))?(?: ! (.*))?")


def parse_rules(text: str) -> list[Rule]:
    """Rules of lines as above."""
    rules = []
    for line in filter(None, text.splitlines()):
        path, kind, optional, size, left, low, high, right, default, choices, never = _LINE.fullmatch(line).groups()
        number = lambda x: float(x) if x else None
        names = lambda x: tuple(n.strip() for n in x.split(",")) if x else ()
        rules.append(Rule(path, kind, default, number(low), number(high), left == "(", right == ")", names(choices), names(never), int(size) if size else None, bool(optional)))
    for name in names_of(rules, "eval.score_weights"):
        rules.append(Rule(f"eval.score_weights.{name}", "float", "null", low=0.0))
    return rules


def names_of(rules: Sequence[Rule], path: str) -> tuple[str, ...]:
    """The keys that a section may have."""
    return next((r.choices for r in rules if r.path == path), ())


CONFIG_RULES = parse_rules(_CONFIG)
BUNDLE_RULES = parse_rules(_BUNDLE)


def _checked(spark: SparkSession, document: dict, rules: Sequence[Rule], relations: Sequence[Relation]) -> dict:
    values = flattened(spark.createDataFrame([(0, json.dumps(document, ensure_ascii=False))], "id INT, raw STRING"), "id")
    found = sorted((r["path"], r["fault"]) for r in faults(values, "id", rules, relations).collect())
    if found:
        raise ValueError("; ".join(f"{path or 'document'}: {fault}" for path, fault in found))
    kinds = {r.path: r.kind for r in rules}
    out: dict = {}
    told = {r["path"]: r["value"] for r in resolved(values, "id", rules).collect() if kinds[r["path"]] != "section"}
    for path, value in sorted(told.items()):
        if value == "null":
            continue
        *above, last = path.split(".")
        at = out
        for key in above:
            at = at.setdefault(key, {})
        at[last] = _typed(kinds[path], value)
    return out


def _typed(kind: str, value: str) -> object:
    """A value as its kind: numbers spelled as text are numbers, texts are stripped."""
    if kind in ("str", "text", "choice", "texts") and value[:1] not in '["':
        text = value.strip()
        return [text] if kind == "texts" else text.lower() if kind == "choice" else text
    if kind == "bool":
        return value in ("true", "1")
    if kind == "float":
        return float(json.loads(value) if value[:1] == '"' else value)
    got = json.loads(value)
    if isinstance(got, list):
        return [x.strip() if isinstance(x, str) else x for x in got]
    return got.strip().lower() if kind == "choice" else got


def read_config(spark: SparkSession, path: str) -> dict:
    """A training configuration (JSON, or YAML where that library is there) with defaults filled in; all faults are reported together."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    try:
        document = json.loads(text)
    except ValueError:
        import yaml  # optional

        document = yaml.safe_load(text)
    if not isinstance(document, dict):
        raise ValueError("a configuration is an object")
    return _checked(spark, document, CONFIG_RULES, RELATIONS)


def check_bundle_description(spark: SparkSession, document: dict) -> dict:
    """The description of a bundle's model, if all of it holds."""
    return _checked(spark, document, BUNDLE_RULES, ())
