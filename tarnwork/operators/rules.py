"""Label rules against the device profile, and summaries of labels and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import has_item, is_external, items_known

STRICT, LENIENT = True, False


def with_profile(labels: DataFrame, profile: DataFrame) -> DataFrame:
    """Left join on the model; a profile is one row a device, so Spark broadcasts it by size."""
    p = profile.select(F.col("name").alias("device_model"), "rack_count", "floor_usable", "cavity_group", F.col("accessories").alias("supported"), F.lit(True).alias("in_profile"))
    return labels.join(p, "device_model", "left").withColumn("in_profile", F.coalesce("in_profile", F.lit(False)))


def unknown_models(labels: DataFrame, profile: DataFrame) -> DataFrame:
    """(device_model, n): known-looking models that the profile lacks."""
    asked = labels.where("is_oven AND device_model IS NOT NULL").where(~is_external(F.col("device_model")))
    return asked.join(profile.select(F.col("name").alias("device_model")), "device_model", "left_anti").groupBy("device_model").agg(F.count("*").alias("n"))


def issues(strict: bool = LENIENT) -> Column:
    """Array of (level, code) of a row of :func:`with_profile`, in rule order."""
    level = F.col("rack_level")
    oven, external = F.col("is_oven"), is_external(F.col("device_model"))
    ours = oven & ~external
    item = has_item(F.col("food_exist"), F.col("container"), F.col("accessory"))
    known = items_known(F.col("food_exist"), F.col("container"), F.col("accessory"))
    checked = ours & F.col("in_profile")
    extra = F.size(F.array_except("accessory", "supported")) > 0
    rules = [
        ("error", "missing_device", oven & F.col("device_model").isNull()),
        ("error", "unknown_device", ours & F.col("device_model").isNotNull() & ~F.col("in_profile")),
        ("error", "rack_out_of_range", checked & (level > F.col("rack_count"))),
        ("error", "rack_floor_unusable", checked & (level == 0) & ~F.col("floor_usable")),
        ("warning", "accessory_unsupported", checked & F.col("supported").isNotNull() & F.col("accessory").isNotNull() & extra),
        ("warning", "rack_without_accessory", ours & (level >= 1) & (F.size("accessory") == 0)),
        ("warning", "rack_missing", ours & level.isNull() & item),
        ("warning", "rack_on_empty", ours & level.isNotNull() & known & ~item),
        ("error", "device_not_oven", ~oven & F.col("device_model").isNotNull()),
        ("warning", "rack_not_oven", ~oven & level.isNotNull()),
    ]
    made = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit("error" if strict else lvl).alias("level"), F.lit(code).alias("code"))) for lvl, code, when in rules]
    return F.array_compact(F.array(*made))


def check_labels(labels: DataFrame, profile: DataFrame, strict: bool = LENIENT) -> DataFrame:
    """``labels`` with profile columns and ``issues``."""
    joined = with_profile(labels, profile)
    external = is_external(F.col("device_model")) & F.col("is_oven")
    # An oven without a model is not external, and null comparisons count as no issue.
    return joined.withColumn("issues", F.when(external, F.expr("CAST(array() AS ARRAY<STRUCT<level: STRING, code: STRING>>)")).otherwise(issues(strict)))


def valid_labels(checked: DataFrame) -> DataFrame:
    """Rows without an error: what ``on_error='skip'`` keeps."""
    return checked.where(~F.exists("issues", lambda i: i["level"] == "error"))


def issue_log(checked: DataFrame, ident: str) -> DataFrame:
    return checked.select(ident, F.explode("issues").alias("i")).select(ident, "i.level", "i.code")


def issue_counts(log: DataFrame, ident: str) -> DataFrame:
    """(level, code, n, example): the example is the first row."""
    return log.groupBy("level", "code").agg(F.count("*").alias("n"), F.min(ident).alias("example"))


def label_summary(labels: DataFrame) -> DataFrame:
    """(field, value, n): totals and histograms, models and levels of ovens only."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("unlabelled"))
    external = is_external(F.col("device_model"))
    known = F.col("is_oven") & F.col("device_model").isNotNull() & ~external
    kind = F.when(~F.col("is_oven"), "non_oven").when(external, "external").when(known, "known").otherwise("no_model")
    empty = F.array(F.lit("unlabelled"))
    parts = [
        ("kind", F.array(kind)),
        ("device_model", F.when(F.col("is_oven"), F.array(text(F.col("device_model"))))),
        ("food", F.array(text(F.col("food_exist")))),
        ("container", F.coalesce("container", empty)),
        ("accessory", F.coalesce("accessory", empty)),
        ("rack", F.when(F.col("is_oven"), F.array(text(F.col("rack_level"))))),
    ]
    long = F.flatten(F.array(*[_tagged(field, values) for field, values in parts]))
    return labels.select(F.explode(long).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def _tagged(field: str, values: Column) -> Column:
    """(field, value) of each of the values; a null array gives none."""
    return F.transform(F.coalesce(values, F.expr("CAST(array() AS ARRAY<STRING>)")), lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))


def task_counts(encoded: DataFrame) -> DataFrame:
    """Valid labels a task of :func:`tarnwork.operators.encode.encode` rows."""
    flags = {"is_oven": F.lit(True), "proj": F.col("group_id") >= 0, "food": F.col("food_known"), "container": F.col("container_known"), "accessory": F.col("accessory_known"), "rack": F.col("rack_known")}
    return encoded.agg(*[F.count_if(c).alias(t) for t, c in flags.items()])


def unseen(train: DataFrame, val: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` in validation that training lacks."""
    return val.select(column).where(F.col(column).isNotNull()).subtract(train.select(column))


def coverage(labels: DataFrame, profile: DataFrame, fewest_groups: int = 2) -> DataFrame:
    """(warning, value) of what labels with ``split`` do not let training or validation show.

    few_groups with their number, only_ovens, one_food_value with the value, and every
    container, accessory or model that validation has and training lacks.
    """
    train, val = labels.where("split = 'train'"), labels.where("split = 'val'")
    known = with_profile(train, profile).where("is_oven AND in_profile")
    groups = known.agg(F.count_distinct("cavity_group").alias("n")).where(F.col("n") < fewest_groups).select(F.lit("few_groups").alias("warning"), F.col("n").cast("string").alias("value"))
    facts = train.agg(F.count_if(~F.col("is_oven")).alias("others"), F.count_distinct("food_exist").alias("foods"), F.min("food_exist").alias("food"))
    ovens = facts.where("others = 0").select(F.lit("only_ovens").alias("warning"), F.lit(None).cast("string").alias("value"))
    foods = facts.where("foods = 1").select(F.lit("one_food_value").alias("warning"), F.col("food").cast("string").alias("value"))
    out = groups.unionByName(ovens).unionByName(foods)
    for column, warning in (("container", "unseen_container"), ("accessory", "unseen_accessory")):
        each = lambda rows, c=column: rows.select(F.explode(c).alias("value"))
        out = out.unionByName(unseen(each(train), each(val), "value").select(F.lit(warning).alias("warning"), "value"))
    return out.unionByName(unseen(train, val, "device_model").select(F.lit("unseen_model").alias("warning"), F.col("device_model").alias("value")))
