"""JSON annotations to labels: missing, null, occluded and empty stay four things.

``VARIANT`` keeps a missing key apart from an explicit null, which ``from_json`` does not.
Broken rows become rows with an ``error`` issue, never an exception.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.columns import EXTERNAL_TOKENS, NONE_TOKENS, OCCLUDED, is_none, let, strip
from tarnwork.operators.rules import check_labels
from tarnwork.sources.scratch import stored

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")


def plain_path(url: Column) -> Column:
    """A file's name as the listing of binary files spells it: no escapes, one slash after a local scheme."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(url, r"\+", "%2B")), "^file:/+", "file:/")


def read_annotations(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(json_path, raw) of every ``*.json`` below ``path``; a byte-order mark is dropped."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive).text(path)
    return files.select(plain_path(F.col("_metadata.file_path")).alias("json_path"), F.regexp_replace("value", "^﻿", "").alias("raw"))


def _named(*paths: str) -> list[Column]:
    """What the annotation says of its image: text that is not blank, with either slash."""
    texts = [F.expr(f"try_variant_get(__doc, '{p}', 'variant')") for p in paths]
    said = [F.when(_kind(v) == "string", strip(v.cast("string"))) for v in texts]
    return [F.translate(F.when(s != "", s), "\\", "/") for s in said]


def with_image(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Adds image_path: the first of these that exists, null if none does.

    The path that ``image`` names (at the top or else inside ``annotations``) beside the
    annotation, its last part beside the annotation, the same for ``image_name``, then the
    annotation's own stem with each known extension, in lower and then in upper case. An
    exact join on ``path`` of the few candidates a row has; a repeated file counts once.
    """
    folder, stem = F.regexp_extract("json_path", r"^(.*/)", 1), F.regexp_replace("json_path", r"\.[^./]+$", "")
    keyed = annotations.withColumn("__doc", F.try_parse_json("raw"))
    names = [F.coalesce(*_named(f"$.{key}", f"$.annotations.{key}")) for key in ("image", "image_name")]
    tries = [F.concat(folder, part) for name in names for part in (F.regexp_replace(name, r"^(\./)+", ""), F.regexp_extract(name, r"([^/]*)$", 1))]
    tries += [F.concat(stem, F.lit(f".{ext}")) for ext in (*IMAGE_EXTENSIONS, *(e.upper() for e in IMAGE_EXTENSIONS))]
    wanted = keyed.select("json_path", F.posexplode(F.array(*tries)).alias("__rank", "path")).where("path IS NOT NULL")
    found = wanted.join(files.select("path").distinct(), "path").groupBy("json_path").agg(F.min_by("path", "__rank").alias("image_path"))
    return annotations.join(found, "json_path", "left")


_NO_ISSUES = "CAST(array() AS ARRAY<STRUCT<level: STRING, code: STRING>>)"


def _missing(spark: SparkSession, folders: Sequence[str]) -> list[str]:
    """The folders that do not exist."""
    gone = []
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            gone.append(folder)
    return gone


def read_split(spark: SparkSession, folders: Sequence[str], profile: DataFrame, containers: Sequence[str], accessories: Sequence[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, images) of ``*.json`` in the folders: parsed, with an image, checked; every row keeps all its issues.

    ``root`` is the number of the folder; rows stand in no order, but (root, json_path) is
    one. ``images`` are the paths of all files. With ``strict`` every issue is an error.
    """
    notes, files = None, None
    for number, folder in enumerate(folders):
        images = spark.read.format("binaryFile").load(folder).select("path")  # names only; contents are not read
        some = read_annotations(spark, folder).withColumn("root", F.lit(number))
        notes, files = (some, images) if notes is None else (notes.unionAll(some), files.unionAll(images))
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    pictured = with_image(notes, files)
    parsed = parse(pictured, containers, accessories).join(pictured.select("json_path", "root", "image_path"), "json_path")
    none = F.expr(_NO_ISSUES)
    lost = F.when(F.col("image_path").isNull() & ~F.exists("issues", lambda i: i["code"] == "bad_json"), F.array(F.struct(F.lit("error").alias("level"), F.lit("missing_image").alias("code")))).otherwise(none)
    parsed = parsed.withColumn("__parsed", F.concat("issues", lost)).drop("issues", "valid")
    ruled = check_labels(parsed, profile)
    both = F.concat("__parsed", F.when(_refused("__parsed"), none).otherwise(F.col("issues")))  # rules judge labels that could be read
    if strict:
        both = F.transform(both, lambda i: F.struct(F.lit("error").alias("level"), i["code"].alias("code")))
    return stored(ruled.withColumn("issues", both).drop("__parsed"), "split-labels"), files


def _refused(issues: str) -> Column:
    return F.exists(issues, lambda i: i["level"] == "error")


def load_split(spark: SparkSession, roots: Sequence[str], split: str, profile: DataFrame, containers: Sequence[str], accessories: Sequence[str], on_error: str = "raise", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labels, issues) of ``<root>/<split>/*.json``: parsed, with an image, checked against the profile.

    ``issues`` is (json_path, level, code); with ``strict`` every one is an error. Rows
    with an error are no labels: ``on_error='skip'`` leaves them out, ``'raise'`` refuses
    the split and names the first 20. An empty split is refused.
    """
    folders = [f"{root.rstrip('/')}/{split}" for root in roots]
    for folder in _missing(spark, folders):
        raise FileNotFoundError(folder)
    checked, _ = read_split(spark, folders, profile, containers, accessories, strict)
    issues = checked.select("json_path", F.inline("issues"))
    n, wrong = checked.agg(F.count("*"), F.count_if(_refused("issues"))).first()
    if not n:
        raise RuntimeError(f"no annotation in {folders}")
    if wrong and on_error == "raise":
        first = issues.where("level = 'error'").orderBy("json_path", "code").limit(20).collect()
        raise ValueError(f"{wrong} of {n} annotations have errors, the first are: " + "; ".join(f"{r['json_path']}: {r['code']}" for r in first))
    if wrong == n:
        raise RuntimeError(f"no label is left in {folders}")
    return checked.where(~_refused("issues")), issues


def diagnose(spark: SparkSession, roots: Sequence[str], splits: Sequence[str], profile: DataFrame, containers: Sequence[str], accessories: Sequence[str], strict: bool = False) -> DataFrame:
    """(split, stage, source, level, code) of every issue of all splits; nothing ends it early.

    Stages, each of which sees what the ones before could read: listing (missing_folder,
    no_annotation), labels (all parser and rule codes, also of refused rows) and contents
    (leaked_content: the same bytes in several splits, a row for every such image).
    """
    log, contents, seen = None, None, []

    def add(rows: DataFrame) -> None:
        nonlocal log
        rows = rows.select("split", "stage", "source", "level", "code")
        log = rows if log is None else log.unionByName(rows)

    def note(split: str, source: str, code: str) -> None:
        add(spark.createDataFrame([(split, "listing", source, "error", code)], "split STRING, stage STRING, source STRING, level STRING, code STRING"))

    for split in splits:
        folders = [f"{root.rstrip('/')}/{split}" for root in roots]
        gone = _missing(spark, folders)
        for folder in gone:
            note(split, folder, "missing_folder")
        there = [f for f in folders if f not in gone]
        if not there:
            continue
        rows, _ = read_split(spark, there, profile, containers, accessories, strict)
        if rows.isEmpty():
            note(split, there[0], "no_annotation")
        add(rows.select(F.lit(split).alias("split"), F.lit("labels").alias("stage"), F.col("json_path").alias("source"), F.inline("issues")))
        for folder in there:
            some = spark.read.format("binaryFile").load(folder).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_EXTENSIONS))
            some = some.select(F.lit(split).alias("split"), F.regexp_replace("path", "^file:/+", "file:/").alias("source"), "length", F.sha2("content", 256).alias("sha"))
            contents = some if contents is None else contents.unionAll(some)
        seen.append(split)
    if len(seen) > 1:
        kept = stored(contents, "split-contents")
        shared = kept.groupBy("length", "sha").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
        add(kept.join(shared, ["length", "sha"], "left_semi").select("split", F.lit("contents").alias("stage"), "source", F.lit("error").alias("level"), F.lit("leaked_content").alias("code")))
    return log if log is not None else spark.createDataFrame([], "split STRING, stage STRING, source STRING, level STRING, code STRING")


def _kind(v: Column) -> Column:
    """void, boolean, bigint, decimal, double, string, array or object; null if missing."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), r"^([A-Za-z]+)", 1))


def _field(ann: Column, key: str) -> Column:
    """(v, kind) of a key, both null if missing."""
    return let(F.try_variant_get(ann, f"$.{key}", "variant"), lambda v: F.struct(v.alias("v"), _kind(v).alias("kind")))


def _items(field: Column) -> Column:
    """A list's elements, or a scalar as a list of one, as variants."""
    return F.when(field["kind"] == "array", field["v"].try_cast("array<variant>")).otherwise(F.array(field["v"]))


def _text(v: Column) -> Column:
    return v.cast("string")


def _stripped_texts(field: Column) -> Column:
    return F.transform(_items(field), lambda x: F.when(_kind(x) != "void", strip(_text(x))))


def _issue(level: str, code: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))


def _name_list(field: Column, classes: Sequence[str], none_tokens: Sequence[str]) -> Column:
    """(value, issues) of a list of names, or of one name."""
    kind, vocabulary = field["kind"], F.array(*map(F.lit, classes))
    listed = kind.isin("array", "string")
    blank = lambda s: s.isNull() | s.isin("", *none_tokens)

    def told(items: Column) -> Column:
        occluded = F.exists(items, lambda s: F.coalesce(s == OCCLUDED, F.lit(False)))
        real = F.array_distinct(F.filter(items, lambda s: ~blank(s)))
        return F.struct(occluded.alias("occluded"), real.alias("real"), F.exists(items, blank).alias("some_none"), F.array_intersect(real, vocabulary).alias("known"))

    def judged(t: Column) -> Column:
        open_list = listed & ~t["occluded"]
        found = [
            _issue("warning", "missing_field", field["v"].isNull()),
            _issue("error", "bad_type", kind.isNotNull() & ~listed & (kind != "void")),
            _issue("warning", OCCLUDED, listed & t["occluded"]),
            _issue("error", "unknown_class", open_list & (F.size(F.array_except(t["real"], vocabulary)) > 0)),
            _issue("warning", "none_with_names", open_list & t["some_none"] & (F.size(t["known"]) > 0)),
        ]
        value = F.when(kind == "void", F.expr("CAST(array() AS ARRAY<STRING>)")).when(open_list, t["known"])
        return F.struct(value.alias("value"), F.array(*found).alias("issues"))

    return let(F.when(listed, _stripped_texts(field)), lambda items: let(told(items), judged))


def _whole_number(s: Column, kind: Column) -> Column:
    digits = F.when(kind == "string", F.when(strip(s).rlike(r"^[0-9]+$"), strip(s)))
    number = F.when(kind.isin("bigint", "decimal", "double", "float"), s.try_cast("double"))
    return F.coalesce(digits.try_cast("int"), F.when((number == F.floor(number)) & (number >= 0), number.try_cast("int")))


def _level(field: Column, none_tokens: Sequence[str]) -> Column:
    """(value, issues) of a level, or of a list with one."""
    each = F.transform(_items(field), lambda x: F.struct(_kind(x).alias("kind"), _text(x).alias("text")))
    said = F.filter(each, lambda x: ~((x["kind"] == "void") | ((x["kind"] == "string") & is_none(x["text"], none_tokens))))

    def judged(items: Column) -> Column:
        one = F.when(F.size(items) == 1, F.get(items, F.lit(0)))
        value = let(one, lambda x: _whole_number(x["text"], x["kind"]))
        return let(value, lambda n: F.struct(n.alias("value"), F.array(_issue("error", "bad_rack_level", (F.size(items) > 1) | ((F.size(items) == 1) & n.isNull()))).alias("issues")))

    return let(F.when(field["v"].isNotNull(), said), judged)


_KEYS = ("device_model", "is_oven", "food_exist", "food_name", "container_type", "accessory_type", "rack_level")


def _label(f: Column, containers: Sequence[str], accessories: Sequence[str], none_tokens: Sequence[str]) -> Column:
    """The label and the issues of an annotation's fields (v, kind)."""
    oven_kind, food_kind, name_kind = (f[k]["kind"] for k in ("is_oven", "food_exist", "food_name"))
    model = F.when(f["device_model"]["kind"] != "void", strip(_text(f["device_model"]["v"])))
    device = let(model, lambda m: F.when(m.isin(*EXTERNAL_TOKENS), m).when(~is_none(m, none_tokens), m))
    by_name = f["food_exist"]["v"].isNull() & f["food_name"]["v"].isNotNull()
    parts = F.struct(
        device.alias("device"), _stripped_texts(f["food_name"]).alias("names"), _name_list(f["container_type"], containers, none_tokens).alias("container"),
        _name_list(f["accessory_type"], accessories, none_tokens).alias("accessory"), _level(f["rack_level"], none_tokens).alias("level"),
    )

    def made(p: Column) -> Column:
        hidden = F.exists(p["names"], lambda s: F.coalesce(s == OCCLUDED, F.lit(False)))
        some_name = F.when(name_kind == "void", F.lit(False)).when(~hidden, F.exists(p["names"], lambda s: s.isNotNull() & ~s.isin("", *none_tokens)))
        food = F.when(food_kind == "void", F.lit(False)).when(food_kind == "boolean", f["food_exist"]["v"].try_cast("boolean")).when(by_name, some_name)
        oven = F.when(oven_kind == "boolean", f["is_oven"]["v"].try_cast("boolean")).otherwise(p["device"].isNotNull())
        own = F.array(
            _issue("error", "bad_type", oven_kind.isNotNull() & ~oven_kind.isin("boolean", "void")),
            _issue("error", "bad_type", food_kind.isNotNull() & ~food_kind.isin("boolean", "void")),
            _issue("warning", OCCLUDED, by_name & hidden),
            _issue("warning", "missing_field", f["food_exist"]["v"].isNull() & f["food_name"]["v"].isNull()),
        )
        issues = F.array_compact(F.concat(own, p["container"]["issues"], p["accessory"]["issues"], p["level"]["issues"]))
        return F.struct(
            oven.alias("is_oven"), p["device"].alias("device_model"), food.alias("food_exist"), p["container"]["value"].alias("container"),
            p["accessory"]["value"].alias("accessory"), p["level"]["value"].alias("rack_level"), issues.alias("issues"),
        )

    return let(parts, made)


def parse(annotations: DataFrame, containers: Sequence[str], accessories: Sequence[str], none_tokens: Sequence[str] = NONE_TOKENS) -> DataFrame:
    """(json_path, is_oven, device_model, food_exist, container, accessory, rack_level, issues, valid).

    ``valid`` is false iff some issue is an error; such a row is no label. The label is one
    expression that binds every value it uses again (``let``). As columns on columns the
    same values are written out anew for each use as soon as a filter on ``valid`` or an
    ``inline`` of the issues is pushed below them, which multiplies over the steps.
    """

    def labelled(doc: Column) -> Column:
        nested = F.try_variant_get(doc, "$.annotations", "variant")
        ann = let(nested, lambda n: F.when(F.coalesce(_kind(n) == "object", F.lit(False)), n).otherwise(doc))
        fields = let(ann, lambda a: F.struct(*[_field(a, k).alias(k) for k in _KEYS]))
        label = let(fields, lambda f: _label(f, containers, accessories, none_tokens))
        broken = F.array(F.struct(F.lit("error").alias("level"), F.lit("bad_json").alias("code")))
        known = F.coalesce(_kind(doc) == "object", F.lit(False))
        return let(label, lambda x: x.withField("issues", F.when(known, x["issues"]).otherwise(broken)))

    label = let(F.try_parse_json("raw"), labelled)
    out = annotations.select("json_path", label.alias("__label"))
    out = out.select("json_path", *[F.col(f"__label.{c}").alias(c) for c in ("is_oven", "device_model", "food_exist", "container", "accessory", "rack_level", "issues")])
    return out.withColumn("valid", ~F.exists("issues", lambda i: i["level"] == "error"))
