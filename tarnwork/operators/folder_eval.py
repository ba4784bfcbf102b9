"""Evaluation of a folder of results against the annotations that lie beside the images.

Both sides become texts that can be compared: null, ``text:`` of a scalar, or ``list:`` of
sorted texts; a list of one is not a scalar unless its field says so. Rewrites of such
values, by field and side, stand for names that mean the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("device_model", "container_type", "accessory_type", "rack_level")
UNWRAPPED = ("rack_level",)  # a truth of one element means that element


@dataclass(frozen=True)
class Rewrite:
    """In ``field``, the list ``found`` counts as ``instead``: in the truth, or on both sides."""

    field: str
    found: tuple[str, ...]
    instead: tuple[str, ...]
    both: bool = False


# Names that are judged as others.
REWRITES = (
    Rewrite("container_type", ("无",), ()),
    Rewrite("accessory_type", ("无",), ()),
    Rewrite("container_type", ("纸质容器",), ("油纸",), both=True),
)


def stem(path: Column) -> Column:
    """The path without the last extension of its last part; a leading dot is no extension."""
    return F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(stem, raw) of every ``*.json`` below ``path``, as it is; raw is null if it begins with a byte-order mark or is no UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    text = F.col("content").cast("string")
    plain = (F.hex(F.substring("content", 1, 3)) != "EFBBBF") & F.is_valid_utf8(text)
    return files.select(stem(F.regexp_replace("path", "^file:/+", "file:/")).alias("stem"), F.when(plain, text).alias("raw"))


def _kind(v: Column) -> Column:
    return F.lower(F.regexp_extract(F.schema_of_variant(v), r"^([A-Za-z]+)", 1))


def _said(v: Column) -> Column:
    """A JSON value as the text that stands for it: truths are capitalised, whole decimals keep a digit."""
    kind, text = _kind(v), v.cast("string")
    decimal = F.when(text.rlike(r"^-?[0-9]+$"), F.concat(text, F.lit(".0"))).otherwise(text)
    return F.when(kind == "void", "None").when(kind == "boolean", F.initcap(text)).when(kind.isin("decimal", "double", "float"), decimal).otherwise(text)


def _listed(texts: Column) -> Column:
    return F.concat(F.lit("list:"), F.to_json(F.array_sort(texts)))


def _literal(texts: Sequence[str]) -> Column:
    return _listed(F.array(*map(F.lit, texts)) if texts else F.expr("CAST(array() AS ARRAY<STRING>)"))


def _truth(field: str) -> Column:
    v = F.expr(f"try_variant_get(__ann, '$.{field}', 'variant')")
    texts = F.transform(v.try_cast("array<variant>"), _said)
    listed = F.when((F.size(texts) == 1), F.concat(F.lit("text:"), F.get(texts, F.lit(0)))).otherwise(_listed(texts)) if field in UNWRAPPED else _listed(texts)
    return F.when(_kind(v) == "array", listed).when(_kind(v) != "void", F.concat(F.lit("text:"), _said(v)))


def truth_values(notes: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(stem, truth) of (stem, raw): a struct of comparable values; null if there is no object ``annotations`` or no object at all.

    An object without ``annotations`` is a truth without values. Nothing raises.
    """
    doc = notes.withColumn("__doc", F.try_parse_json("raw"))
    ann = F.expr("try_variant_get(__doc, '$.annotations', 'variant')")
    read = doc.withColumn("__ann", F.when(_kind(F.col("__doc")) == "object", F.coalesce(ann, F.expr("parse_json('{}')"))))
    some = _kind(F.col("__ann")) == "object"
    return read.select("stem", F.when(some, F.struct(*[_truth(f).alias(f) for f in fields])).alias("truth"))


def _result(column: str, kind: str) -> Column:
    x = F.col(column)
    if kind.startswith("array"):
        return F.when(x.isNotNull(), _listed(F.transform(x, lambda e: F.coalesce(e.cast("string"), F.lit("None")))))
    return F.when(x.isNotNull(), F.concat(F.lit("text:"), F.initcap(x.cast("string")) if kind == "boolean" else x.cast("string")))


def judged(results: DataFrame, truth: DataFrame, fields: Sequence[str] = FIELDS, rewrites: Sequence[Rewrite] = REWRITES) -> DataFrame:
    """(image, judged, errors) of results (image, fields): what each image without a readable truth is not judged by.

    ``truth`` is (stem, truth). ``errors`` has field, predicted and expected of every field
    that differs; two nulls are equal. Several images may share one truth.
    """
    kinds = dict(results.dtypes)
    said = results.select("image", stem(F.col("image")).alias("stem"), *[_result(f, kinds[f]).alias(f) for f in fields])
    both = said.join(truth, "stem", "left")

    def rewritten(value: Column, field: str, is_truth: bool) -> Column:
        for rule in rewrites:
            if rule.field == field and (is_truth or rule.both):
                value = F.when(value == _literal(rule.found), _literal(rule.instead)).otherwise(value)
        return value

    def error(field: str) -> Column:
        predicted, expected = rewritten(F.col(field), field, False), rewritten(F.col(f"truth.{field}"), field, True)
        return F.when(~predicted.eqNullSafe(expected), F.struct(F.lit(field).alias("field"), predicted.alias("predicted"), expected.alias("expected")))

    errors = F.array_compact(F.array(*map(error, fields)))
    known = F.col("truth").isNotNull()
    return both.select("image", known.alias("judged"), F.when(known, errors).alias("errors"))


def accuracy(verdicts: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(field, ok, total, rate) over the judged images; every field has a row, and rate 0 without any."""
    wrong = lambda f: F.exists("errors", lambda e: e["field"] == f)
    counts = verdicts.agg(F.count_if("judged").alias("total"), *[F.count_if(F.col("judged") & wrong(f)).alias(f) for f in fields])
    ok = lambda f: F.col("total") - F.col(f)
    rate = lambda f: F.when(F.col("total") > 0, F.round(ok(f) / F.col("total"), 4)).otherwise(0.0)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), ok(f).alias("ok"), F.col("total"), rate(f).alias("rate")) for f in fields])))
