"""How the driver's tables play the roles of labels, profiles, galleries and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINERS = ("glass", "metal", "foil")
ACCESSORIES = ("tray", "grill", "spit")
TAU = 0.35
LEVELS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _some(**names: Column) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in names.items()]))


def brand_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device profile of the brands; every seventh is missing."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    no = F.regexp_replace("name", "[^0-9]", "").try_cast("int")
    supported = F.when(no % 3 == 1, F.array(F.lit("tray"))).when(no % 3 == 2, F.array(F.lit("tray"), F.lit("grill")))
    return brands.where(no % 7 != 0).select("name", (1 + no % 8).alias("rack_count"), (no % 2 == 0).alias("floor_usable"), F.concat(F.lit("G"), (no % 5).cast("string")).alias("cavity_group"), supported.alias("accessories"))


def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label row for every line item."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    both = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    line, oven = F.col("l_linenumber"), F.col("l_returnflag") != "R"
    model = F.when(~oven & (line != 7), None).when(F.col("p_size") % 10 == 0, "未知").when(F.col("p_size") % 13 == 0, None).otherwise(F.col("p_brand"))
    food = F.when(F.col("l_tax") < 0.07, F.col("l_discount") >= 0.05)
    container = F.when(line != 6, _some(glass=F.col("l_partkey") % 2 == 0, metal=F.col("l_suppkey") % 3 == 0, foil=F.col("l_orderkey") % 5 == 0))
    accessory = F.when(line != 5, _some(tray=F.col("l_partkey") % 3 == 0, grill=F.col("l_suppkey") % 4 == 0, spit=F.col("l_orderkey") % 7 == 0))
    level = F.when(F.col("l_quantity") >= 10, line - 1)
    return both.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", oven.alias("is_oven"), model.alias("device_model"), food.alias("food_exist"), container.alias("container"), accessory.alias("accessory"), level.alias("rack_level"))


def level_logits() -> Column:
    seed = F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7
    return F.array(*[((seed + 13 * k * (F.col("l_linenumber") + 1)) % 41).cast("double") / 10 for k in range(LEVELS)])


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose level their brand's device has, with raw level logits."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("model"))
    profile = brand_profile(spark, sf_dir).select(F.col("name").alias("model"), "rack_count", "floor_usable", "cavity_group")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(profile, "model")
    rows = rows.withColumn("level", (F.col("l_linenumber") - 1).cast("int")).withColumn("raw", level_logits())
    rows = rows.where((F.col("level") <= F.col("rack_count")) & ((F.col("level") > 0) | F.col("floor_usable")))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "model", "cavity_group", "rack_count", "floor_usable", "level", "raw")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, references): every row asks; labels below 8 are known models.

    A row never finds itself. Labels from 8 on are devices of other makers.
    """
    rows = table(spark, sf_dir, "embeddings")
    model, group = F.concat(F.lit("M"), F.col("label").cast("string")), F.concat(F.lit("G"), F.floor(F.col("label") / 2).cast("string"))
    both = rows.select("vec_id", "label", F.col("embedding").alias("v"), model.alias("model"), group.alias("cavity_group"))
    queries = both.select(F.col("vec_id").alias("q_id"), "v", "model", "cavity_group", (F.col("label") >= 8).alias("external"))
    return queries, both.where("label < 8").select(F.col("vec_id").alias("ref_id"), "v", "model", "cavity_group")


def model_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device profile of the embedding labels below 8."""
    labels = table(spark, sf_dir, "embeddings").where("label < 8").select("label").distinct()
    half = F.floor(F.col("label") / 2).cast("int")
    supported = F.when(F.col("label") % 3 == 1, F.array(F.lit("tray"))).when(F.col("label") % 3 == 2, F.array(F.lit("tray"), F.lit("grill")))
    return labels.select(F.concat(F.lit("M"), F.col("label").cast("string")).alias("name"), (1 + half).alias("rack_count"), (half % 2 == 0).alias("floor_usable"), F.concat(F.lit("G"), half.cast("string")).alias("cavity_group"), supported.alias("accessories"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every embedding row, from its components."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"), (0.6 + e(0)).alias("is_oven_prob"), (0.5 + e(1)).alias("food_prob"), F.array(0.5 + e(2), 0.4 + e(3)).alias("container_prob"),
        F.array(0.5 + e(4), 0.4 + e(5)).alias("accessory_prob"), F.array(*[10 * e(6 + k) for k in range(6)]).alias("raw"),
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cls, score, target) of all events: cheap ones tend to be purchases."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("cls"), (1 / (1 + F.col("value") / 50)).alias("score"), ((F.col("user_id") + F.floor(F.col("value"))) % 3 == 0).alias("target"))


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left-joined with labels: no label means unknown."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cls, score, target) of the known labels of all documents."""
    rows = document_labels(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(c).alias("cls"), ((F.col("n_chars") * m) % 997 / 997.0).alias("score"), (F.col(c) == 1).alias("target")) for c, m in (("quality", 7), ("toxic", 13))])
    return rows.select(F.inline(each)).where("target IS NOT NULL")


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(json_path, raw): an annotation for every event, with every way to spell, omit and spoil a field."""
    def field(key: str, number: Column, spellings: list[str]) -> Column:
        made = F.array(*[F.lit(f'"{key}": {x}' if x else None).cast("string") for x in spellings])
        return F.get(made, (number % len(spellings)).cast("int"))

    e, u = F.col("event_id"), F.col("user_id")
    food = [None, '"food_exist": null', '"food_exist": true', '"food_name": ["x"]', '"food_name": ["遮挡", "x"]', '"food_name": null', '"food_exist": 1']
    parts = [
        field("device_model", u, ["", "null", '"未知"', '" A "', '"无"', '"B"']), field("is_oven", e, ["", "null", "true", "false", ""]), F.get(F.array(*[F.lit(x).cast("string") for x in food]), (e % 7).cast("int")),
        field("container_type", e, ["", "null", '["glass", " glass"]', '"metal"', "[1]", *6 * ['["glass", "无", "metal"]']]), field("rack_level", u, ["", '"1"', "[2]", '["1", "1"]', '["底板层", "2"]', "3.0", "true", '"无"']),
    ]
    raw = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))
    return table(spark, sf_dir, "events").select(e.cast("string").alias("json_path"), raw.alias("raw"))


def _pick(number: Column, *texts: str | None) -> Column:
    """The text at ``number`` modulo how many there are."""
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), (number % len(texts)).cast("int"))


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("}"))


def folder_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for every event, as a directory run would give it."""
    e, u = F.col("event_id"), F.col("user_id")
    words = lambda number, *lists: F.element_at(F.array(*[F.array(*map(F.lit, x)) if x else F.expr("CAST(array() AS ARRAY<STRING>)") for x in lists]), (1 + number % len(lists)).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/d/"), (e % 7).cast("string"), F.lit("/"), e.cast("string"), F.lit(".jpg")).alias("image"), _pick(u, "M0", "M1", "M2", None).alias("device_model"),
        words(u, (), ("油纸",), ("纸质容器",)).alias("container_type"), words(e, ("a", "b"), ()).alias("accessory_type"), (e % 3).cast("int").alias("rack_level"),
    )


def folder_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, raw): annotations beside most results; some are broken, some say nothing of the image."""
    e, u = F.col("event_id"), F.col("user_id")
    fields = _object(
        _pick(u, '"device_model": "M0"', '"device_model": "M1"', '"device_model": null'), _pick(u, '"container_type": ["无"]', '"container_type": []', '"container_type": ["纸质容器"]', '"container_type": ["x", "油纸"]', '"container_type": "油纸"'),
        _pick(e, '"accessory_type": ["b", "a"]', None, '"accessory_type": ["无"]', '"accessory_type": true'), _pick(e, None, '"rack_level": 1', '"rack_level": [2]', '"rack_level": "0"', '"rack_level": 1.0', '"rack_level": [2, null]'),
    )
    raw = F.when(e % 13 == 0, '{"annotations": ').when(e % 13 == 1, '{"device_model": "M1"}').when(e % 13 == 2, '{"annotations": [1]}').when(e % 13 == 3, '{"annotations": null}').otherwise(F.concat(F.lit('{"annotations": '), fields, F.lit("}")))
    return table(spark, sf_dir, "events").where(e % 11 != 0).select(F.concat(F.lit("/d/"), (e % 7).cast("string"), F.lit("/"), e.cast("string")).alias("stem"), raw.alias("raw"))


def order_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): a settings document for every order, with every way to be wrong."""
    k = F.col("o_orderkey")
    fields = _object(
        _pick(k, None, '"n": null', '"n": 3', '"n": 3.5', '"n": true', '"n": 0', '"n": 12'), _pick(k, None, '"f": "0.25"', '"f": "x"', '"f": 1.0', '"f": 0.5'), _pick(k, '"b": true', '"b": 1', '"b": 2', '"b": "yes"'),
        _pick(k, '"t": " a "', '"t": ""', '"t": 5'), _pick(k, None, '"s": {"c": "X"}', '"s": {"c": "q"}', '"s": {"l": ["a", " a"]}', '"s": {"l": [], "c": "y"}', '"s": 7', '"s": {"zz": {"deep": [1, {"er": 2.5}]}}', '"s": null', '"s": {"l": ["bad"]}'),
    )
    raw = F.when(k % 101 == 0, '{"n": ').when(k % 103 == 0, "[1, 2]").otherwise(fields)
    return table(spark, sf_dir, "orders").select(k.alias("id"), raw.alias("raw"))
