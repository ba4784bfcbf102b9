"""Raw annotations to training annotations: one canonical spelling, or a reason for refusal.

Where the label parser turns faults into issues, the generator refuses the whole
annotation, with the first fault in ``error``: nothing half-read reaches a training set.
Everything is read through ``VARIANT``; a key that is missing stays missing (null), an
explicit null is "none". Digits are ASCII digits. Lists inside a rack list are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import EXTERNAL_TOKENS, NONE_TOKENS, OCCLUDED, is_none, strip

FLOOR = "底板层"  # fixed value: the spelling of level 0
EXTERNAL = EXTERNAL_TOKENS[0]  # what both tokens of other makers become


def _kind(v: Column) -> Column:
    """void, boolean, bigint, decimal, double, string, array or object; null if missing."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), r"^([A-Za-z]+)", 1))


def _get(key: str) -> Column:
    return F.expr(f"try_variant_get(__ann, '$.{key}', 'variant')")


def _elements(v: Column) -> Column:
    """(kind, text) of a list's elements, or of a scalar as a list of one; null if missing."""
    each = F.when(_kind(v) == "array", v.try_cast("array<variant>")).otherwise(F.array(v))
    return F.when(v.isNotNull(), F.transform(each, lambda x: F.struct(_kind(x).alias("kind"), F.when(_kind(x) != "void", x.cast("string")).alias("text"))))


def _blank(x: Column, none_tokens: Sequence[str]) -> Column:
    return (x["kind"] == "void") | ((x["kind"] == "string") & is_none(x["text"], none_tokens))


def _names(elements: str, kind: str, none_tokens: Sequence[str]) -> tuple[Column, Column]:
    """(distinct stripped names, whether the value is no name, list of names or none)."""
    real = F.filter(elements, lambda x: ~_blank(x, none_tokens))
    wrong = F.col(kind).isNotNull() & (~F.col(kind).isin("array", "string", "void") | F.exists(real, lambda x: x["kind"] != "string"))
    return F.array_distinct(F.transform(real, lambda x: strip(x["text"]))), F.coalesce(wrong, F.lit(False))


def _level(x: Column, none_tokens: Sequence[str]) -> Column:
    """-1 for a fault, null for none, else the level."""
    text = strip(x["text"])
    number = F.when(x["kind"].isin("bigint", "decimal", "double", "float"), x["text"].try_cast("double"))
    whole = F.when((number >= 0) & (number == F.floor(number)), number.try_cast("int"))
    said = F.when(x["kind"] == "string", F.when(text == FLOOR, 0).when(text.rlike("^[0-9]+$"), text.try_cast("int")))
    return F.when(_blank(x, none_tokens), F.lit(None).cast("int")).otherwise(F.coalesce(said, whole, F.lit(-1)))


def normalise(annotations: DataFrame, none_tokens: Sequence[str] = NONE_TOKENS) -> DataFrame:
    """``annotations`` (with ``raw``) and error, device_model, is_oven, food_exist, container_type, accessory_type, rack_level, multi_rack_level.

    ``error`` is null for a good annotation; the other columns count only then. Several
    different levels are no label: rack_level is null and multi_rack_level keeps them as
    JSON; levels that are equal are one.
    """
    rows = annotations.withColumn("__doc", F.try_parse_json("raw")).withColumn("__root", _kind(F.col("__doc")))
    rows = rows.withColumn("__nested", F.expr("try_variant_get(__doc, '$.annotations', 'variant')")).withColumn("__inner", _kind(F.col("__nested")))
    rows = rows.withColumn("__ann", F.when(F.col("__inner") == "object", F.col("__nested")).otherwise(F.col("__doc")))
    keys = ("device_model", "is_oven", "food_exist", "food_name", "container_type", "accessory_type", "rack_level")
    rows = rows.withColumns({f"__k_{k}": _kind(_get(k)) for k in keys} | {f"__e_{k}": _elements(_get(k)) for k in keys[3:]})
    names = {k: _names(f"__e_{k}", f"__k_{k}", none_tokens) for k in keys[3:6]}
    rows = rows.withColumns({f"__n_{k}": n for k, (n, _) in names.items()} | {f"__bad_{k}": bad for k, (_, bad) in names.items()})
    kind = {k: F.col(f"__k_{k}") for k in keys}

    said = F.when(kind["device_model"] == "string", strip(_get("device_model").cast("string")))
    device = F.when(said.isin(*EXTERNAL_TOKENS), EXTERNAL).when(~is_none(said, none_tokens), said)
    rows = rows.withColumn("__device", device).withColumn("__external", F.coalesce(F.col("__device") == EXTERNAL, F.lit(False)))
    given = kind["is_oven"].isNotNull() & (kind["is_oven"] != "void")
    rows = rows.withColumn("__oven", F.when(given, _get("is_oven").try_cast("boolean")).otherwise(F.col("__device").isNotNull()))
    rows = rows.withColumn("__levels", F.array_distinct(F.transform("__e_rack_level", lambda x: _level(x, none_tokens))))
    rows = rows.withColumn("__real", F.array_compact("__levels"))

    oven, by_name = F.col("__oven"), kind["food_exist"].isNull() & kind["food_name"].isNotNull()
    racked = ~F.col("__external") & oven
    faults = [
        ("not_an_object", F.coalesce(F.col("__root") != "object", F.lit(True))),
        ("annotations_not_an_object", F.col("__inner").isNotNull() & (F.col("__inner") != "object")),
        ("device_not_text", kind["device_model"].isNotNull() & ~kind["device_model"].isin("string", "void")),
        ("oven_not_boolean", given & (kind["is_oven"] != "boolean")),
        ("external_not_oven", F.col("__external") & ~oven),
        ("device_not_oven", ~oven & F.col("__device").isNotNull()),
        ("oven_without_device", oven & F.col("__device").isNull()),
        ("food_not_boolean", kind["food_exist"].isNotNull() & ~kind["food_exist"].isin("boolean", "void")),
        ("bad_food_name", by_name & F.col("__bad_food_name")),
        ("bad_container_type", F.col("__bad_container_type")),
        ("bad_accessory_type", F.col("__bad_accessory_type")),
        ("bad_rack_level", racked & F.array_contains("__levels", -1)),
    ]
    error = F.coalesce(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in faults])
    food = F.when(kind["food_exist"] == "void", False).when(kind["food_exist"] == "boolean", _get("food_exist").try_cast("boolean"))
    food = F.coalesce(food, F.when(by_name & ~F.array_contains("__n_food_name", OCCLUDED), F.size("__n_food_name") > 0))
    several = racked & (F.size("__real") > 1) & ~F.array_contains("__real", -1)
    out = {
        "error": error, "device_model": F.col("__device"), "is_oven": oven, "food_exist": food, "container_type": F.col("__n_container_type"), "accessory_type": F.col("__n_accessory_type"),
        "rack_level": F.when(racked & (F.size("__real") == 1) & (F.get("__real", F.lit(0)) >= 0), F.get("__real", F.lit(0))), "multi_rack_level": F.when(several, F.to_json(_get("rack_level"))),
    }
    return rows.select(*annotations.columns, *[c.alias(n) for n, c in out.items()])


def collect_pairs(annotations: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Good annotations with an image, under output names of their own.

    ``annotations`` (json_path, raw), ``files`` (path, and size and sha256 for content
    groups, which :func:`tarnwork.operators.split.content_groups` adds to the result).
    """
    from tarnwork.operators.split import unique_stems
    from tarnwork.sources.annotations import with_image

    good = normalise(with_image(annotations, files)).where("error IS NULL AND image_path IS NOT NULL")
    named = good.withColumn("stem", F.regexp_extract("json_path", r"([^/]*?)\.[^./]*$", 1))
    named = named.withColumn("relative", F.expr(f"substr(json_path, {len(root.rstrip('/')) + 2})"))
    return unique_stems(named, "relative", "stem").drop("stem")
