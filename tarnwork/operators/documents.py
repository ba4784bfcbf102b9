"""JSON documents of any depth as rows, rows as documents, and tables of rules about them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import let, strip
from tarnwork.sources.scratch import stored

_KINDS = {"void": "null", "boolean": "bool", "bigint": "int", "decimal": "float", "double": "float", "float": "float", "string": "string", "array": "list", "object": "object"}
_NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf(inity)?|nan)$"


def _kind(schema: Column) -> Column:
    short = F.substring_index(F.substring_index(schema, "<", 1), "(", 1)  # upper case, as Spark writes it
    return let(short, lambda t: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for name, kind in _KINDS.items() for x in (name.upper(), kind)]), t), F.lower(t)))


def kind_of(v: Column) -> Column:
    """null, bool, int, float, string, list or object; a whole number with a fraction, as 3.0, is a float."""
    return _kind(F.schema_of_variant(v))


def _depth(raw: Column) -> Column:
    """How deep brackets are nested in a JSON text, at least as deep as its values."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\\.", ""), r'"[^"]*"', "")
    steps = F.transform(F.split(F.translate(F.regexp_replace(bare, r"[^\[\]{}]", ""), "[]{}", "+-+-"), ""), lambda c: F.when(c == "+", 1).when(c == "-", -1).otherwise(0))
    run = F.struct(F.lit(0).alias("here"), F.lit(0).alias("most"))
    deepest = F.aggregate(steps, run, lambda a, x: F.struct((a["here"] + x).alias("here"), F.greatest(a["most"], a["here"] + x).alias("most")), lambda a: a["most"])
    opened = F.length(raw) - F.length(F.translate(raw, "[{", ""))
    return F.when(opened <= 8, opened).otherwise(deepest)  # few brackets cannot be deep


def _children(path: Column, v: Column) -> Column:
    """(path, v) of what a container holds; nothing for other values."""
    quoted = lambda k: F.when(k.rlike(r'[.\[\]"]'), F.concat(F.lit('"'), F.regexp_replace(k, '"', '\\\\"'), F.lit('"'))).otherwise(k)
    child = lambda step, v: F.struct(F.concat(path, step).alias("path"), v.alias("v"))
    fields = F.transform(F.map_entries(v.try_cast("map<string, variant>")), lambda e: child(F.concat(F.when(path == "", "").otherwise("."), quoted(e["key"])), e["value"]))
    places = F.transform(v.try_cast("array<variant>"), lambda x, i: child(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))
    return F.coalesce(fields, places, F.expr("CAST(array() AS ARRAY<STRUCT<path: STRING, v: VARIANT>>)"))


def flattened(docs: DataFrame, ident: str, raw: str = "raw") -> DataFrame:
    """(ident, path, kind, value, items) of every value in JSON documents (ident, raw), containers and the root too.

    ``value`` is the text of a string and the JSON of all else, ``items`` the kinds of a
    list's elements; paths join keys by dots and
    list places as ``[0]``; a key with a dot or bracket is quoted. What is no JSON has one
    row of kind ``broken``. Documents are dealt out by ident, so that what groups the result
    by it needs no shuffle. A row takes its document apart level by level, as deep as its
    own text is nested; nothing is written and nothing is read twice.
    """
    dealt = docs.select(ident, F.col(raw).alias("raw")).repartition(ident)
    parsed = dealt.select(ident, "raw", F.try_parse_json("raw").alias("v"))
    level = F.array(F.struct(F.lit("").alias("path"), F.col("v").alias("v")))

    def deeper(found: Column, _: Column) -> Column:
        below = F.flatten(F.transform(found["last"], lambda x: _children(x["path"], x["v"])))
        return let(below, lambda b: F.struct(F.concat(found["all"], b).alias("all"), b.alias("last")))

    steps = F.when(F.col("v").isNull() | (_depth(F.col("raw")) < 1), F.expr("CAST(array() AS ARRAY<INT>)")).otherwise(F.sequence(F.lit(1), _depth(F.col("raw"))))
    found = F.aggregate(steps, F.struct(level.alias("all"), level.alias("last")), deeper, lambda a: a["all"])
    rows = parsed.select(ident, F.when(F.col("v").isNull(), F.col("raw")).alias("broken"), F.inline(found))
    kinds = rows.select(ident, "path", F.when(F.col("v").isNull(), "broken").otherwise(let(F.schema_of_variant("v"), _kind)).alias("kind"), "v", "broken")
    text = F.when(F.col("kind") == "string", F.col("v").cast("string")).when(F.col("kind") == "broken", F.col("broken")).otherwise(F.to_json("v"))
    items = F.when(F.col("kind") == "list", F.transform(F.col("v").try_cast("array<variant>"), kind_of))
    return kinds.select(ident, "path", "kind", text.alias("value"), items.alias("items"))


def nested(metrics: DataFrame, ident: str, name: str = "metric", value: str = "value", separator: str = r"\.") -> DataFrame:
    """(ident, document): rows (ident, name, value) as one JSON object each, names cut at the separator.

    Levels are folded from the deepest up, so a group holds the children of one object
    only. Keys are in order; null values are kept as nulls. A name that is both a value and
    an object is refused.
    """
    parts = metrics.select(ident, F.split(F.col(name), separator).alias("keys"), F.to_json(F.struct(F.col(value).alias("v")), {"ignoreNullFields": "false"}).alias("json"))
    level = stored(parts.select(ident, "keys", F.regexp_replace("json", r'^\{"v":|\}$', "").alias("json")), "metric-names")
    deepest = level.agg(F.max(F.size("keys"))).first()[0] or 0
    quoted = F.regexp_replace(F.to_json(F.array(F.element_at("keys", -1))), r"^\[|\]$", "")
    entry = F.concat(quoted, F.lit(":"), F.col("json"))
    folded = None
    for depth in range(deepest, 0, -1):
        mine = level.where(F.size("keys") == depth).select(ident, "keys", "json")
        mine = mine if folded is None else mine.unionByName(folded)
        pairs = mine.select(ident, F.slice("keys", 1, F.size("keys") - 1).alias("above"), F.element_at("keys", -1).alias("key"), entry.alias("entry"))
        groups = pairs.groupBy(ident, "above").agg(F.array_sort(F.collect_list(F.struct("key", "entry"))).alias("held"))
        twice = F.size(F.array_distinct(F.transform("held", lambda e: e["key"]))) < F.size("held")
        body = F.array_join(F.transform("held", lambda e: e["entry"]), ",")
        refused = F.raise_error(F.concat(F.lit("a name is used twice below "), F.array_join("above", ".")))
        folded = groups.select(ident, F.col("above").alias("keys"), F.when(twice, refused).otherwise(F.concat(F.lit("{"), body, F.lit("}"))).alias("json"))
    empty = level.select(ident, F.col("json").alias("document")).where("false")
    return empty if folded is None else folded.select(ident, F.col("json").alias("document"))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """What one path of a document must be.

    ``kind``: section, int, float, bool, str, choice, str_list, int_list, float_list, text
    (a string or null) or texts (a string, or some). Without ``default`` (JSON) the value
    must be there. ``choices`` are the values of a choice, the keys of a section or all names of a list;
    ``never`` are elements that a list must not have, ``size`` is a list's length.
    """

    path: str
    kind: str
    default: str | None = None
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False
    choices: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    size: int | None = None
    may_be_empty: bool = False


@dataclass(frozen=True)
class Relation:
    """Between two values of a document: within, apart_from, at_most, some_positive (of a section's values)."""

    path: str
    how: str
    other: str = ""


def rule_table(rules: Sequence[Rule], like: DataFrame) -> DataFrame:
    """The rules as a table, one row a path."""
    number = lambda x: None if x is None else float(x)
    rows = [(r.path, r.kind, r.default, number(r.low), number(r.high), r.low_open, r.high_open, list(r.choices), list(r.never), r.size, r.may_be_empty) for r in rules]
    schema = "path STRING, rule STRING, fallback STRING, low DOUBLE, high DOUBLE, low_open BOOLEAN, high_open BOOLEAN, choices ARRAY<STRING>, never ARRAY<STRING>, size INT, may_be_empty BOOLEAN"
    return like.sparkSession.createDataFrame(rows, schema)


def _found() -> list[tuple[str, Column]]:
    """(fault, condition) of a present value (kind, value, items) under its rule."""
    kind, rule, value = F.col("kind"), F.col("rule"), F.col("value")
    is_a = lambda *rules: rule.isin(*rules)
    items = F.when(kind == "list", F.try_parse_json("value").try_cast("array<variant>"))
    kinds, texts = F.col("items"), F.transform(items, lambda x: x.cast("string"))
    written = F.when(kind == "string", strip(value)).otherwise(value)
    number = F.when(kind.isin("int", "float") | ((kind == "string") & is_a("float") & written.rlike(_NUMBER)), written.try_cast("double"))
    numbers = F.transform(texts, lambda t: t.try_cast("double"))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    names = F.transform(texts, strip)

    def outside(x: Column) -> Column:
        low = F.when(F.col("low_open"), x <= F.col("low")).otherwise(x < F.col("low"))
        high = F.when(F.col("high_open"), x >= F.col("high")).otherwise(x > F.col("high"))
        return F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False))

    all_of = lambda *ks: (kind == "list") & F.forall(kinds, lambda k: k.isin(*ks))
    fits = (
        F.when(is_a("section"), kind == "object").when(is_a("int"), kind == "int").when(is_a("float"), number.isNotNull())
        .when(is_a("bool"), (kind == "bool") | ((kind == "int") & value.isin("0", "1"))).when(is_a("str", "text"), kind == "string").when(is_a("choice"), F.lit(True))
        .when(is_a("str_list"), all_of("string")).when(is_a("int_list"), all_of("int")).when(is_a("float_list"), all_of("int", "float"))
        .when(is_a("texts"), (kind == "string") | (all_of("string") & (F.size(items) > 0)))
    )
    is_list = is_a("int_list", "float_list")
    return [
        ("type", ~fits),
        ("not_finite", fits & is_a("float") & ~finite(number)),
        ("range", fits & ((is_a("int", "float") & finite(number) & outside(number)) | (is_list & F.exists(numbers, outside)))),
        ("blank", fits & ((is_a("str", "texts") & (kind == "string") & (strip(value) == "")) | (is_a("texts") & F.exists(names, lambda t: t == "")))),
        ("choice", is_a("choice") & ~F.array_contains("choices", F.lower(strip(value)))),
        ("size", fits & is_list & F.col("size").isNotNull() & (F.size(items) != F.col("size"))),
        ("empty", fits & is_a("str_list") & ~F.col("may_be_empty") & (F.size(items) == 0)),
        ("repeated", fits & is_a("str_list") & (F.size(F.array_distinct(names)) < F.size(names))),
        ("never", fits & is_a("str_list") & F.arrays_overlap(names, F.col("never"))),
        ("names", fits & is_a("str_list") & (F.size("choices") > 0) & (F.array_sort(names) != F.array_sort("choices"))),
        ("unknown_key", fits & is_a("section") & (F.size("choices") > 0) & (F.size(F.array_except(F.json_object_keys("value"), F.col("choices"))) > 0)),
    ]


def faults(values: DataFrame, ident: str, rules: Sequence[Rule], relations: Sequence[Relation] = ()) -> DataFrame:
    """(ident, path, fault) of flattened documents: every fault of every document, none ends the search.

    Present values meet the rule table by path; paths without a value are the difference of
    the required ones and a document's own. A null counts as missing. A section that is
    missing or no object has that fault alone, not its contents'; defaults are taken as
    valid. Relations are judged on values and defaults, where both are there.
    """
    table = rule_table(rules, values)
    known = {r.path: r for r in rules}
    present = values.join(table, "path")
    judged = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(fault)) for fault, when in _found()]), lambda x: x.isNotNull())
    wrong = present.where("kind <> 'null'").select(ident, "path", F.explode(judged).alias("fault"))

    above = lambda path: path.rpartition(".")[0]
    wanted = [F.struct(F.lit(r.path).alias("path"), F.lit(above(r.path)).alias("above"), F.lit(above(r.path) in known and known[above(r.path)].default is not None).alias("may_lack")) for r in rules if r.default is None and r.kind != "text"]
    kinds = F.map_from_entries(F.collect_list(F.when((F.col("path") == "") | F.col("path").isin(*known), F.struct("path", "kind"))))
    held = values.groupBy(ident).agg(kinds.alias("kinds"))
    of = lambda path: F.coalesce(F.try_element_at("kinds", path), F.lit("null"))
    is_object = of(F.lit("")) == "object"
    open_above = lambda r: is_object & ((of(r["above"]) == "object") | ((of(r["above"]) == "null") & r["may_lack"]))
    lacking = F.filter(F.array(*wanted), lambda r: (of(r["path"]) == "null") & open_above(r)) if wanted else F.expr("CAST(array() AS ARRAY<STRUCT<path: STRING>>)")
    missing = held.select(ident, F.explode(F.transform(lacking, lambda r: r["path"])).alias("path")).withColumn("fault", F.lit("missing"))
    root = held.where(~is_object).select(ident, F.lit("").alias("path"), F.when(of(F.lit("")) == "broken", "broken").otherwise("type").alias("fault"))
    out = wrong.unionByName(missing).unionByName(root)
    if relations:
        named = {p for r in relations for p in (r.path, r.other)}
        fallbacks = [F.struct(F.lit(r.path).alias("path"), F.lit(_json_kind(r.default)).alias("kind"), F.lit(r.default).alias("value")) for r in rules if r.default is not None and r.path in named]
        told = values.where(F.col("path").isin(*named) & (F.col("kind") != "null")).select(ident, "path", "kind", "value")
        if fallbacks:
            unsaid = F.filter(F.array(*fallbacks), lambda r: is_object & (of(r["path"]) == "null"))
            told = told.unionByName(held.select(ident, F.inline(unsaid)))
        told = stored(told, "document-relations")
        for relation in relations:
            out = out.unionByName(_unrelated(told, ident, relation))
    return out


def _json_kind(text: str) -> str:
    return {"[": "list", "{": "object", '"': "string"}.get(text[0], "scalar")


def _unrelated(values: DataFrame, ident: str, relation: Relation) -> DataFrame:
    """Where a relation does not hold."""
    number = lambda c: F.col(c).try_cast("double")
    names = lambda c: F.transform(F.try_parse_json(c).try_cast("array<string>"), strip)
    mine = values.where(F.col("path") == relation.path).select(ident, "kind", F.col("value").alias("a"))
    if relation.how == "some_positive":
        entries = F.map_values(F.from_json("a", "MAP<STRING, DOUBLE>"))
        broken = mine.where((F.col("kind") == "object") & ~F.exists(entries, lambda x: x > 0))
    else:
        both = mine.join(values.where(F.col("path") == relation.other).select(ident, F.col("kind").alias("other_kind"), F.col("value").alias("b")), ident)
        lists = (F.col("kind") == "list") & (F.col("other_kind") == "list")
        holds = {
            "within": lists & (F.size(F.array_except(names("a"), names("b"))) > 0), "apart_from": lists & F.arrays_overlap(names("a"), names("b")),
            "at_most": (number("a") > number("b")) & (number("a") < float("inf")) & ~F.isnan(number("a")),
        }
        broken = both.where(holds[relation.how])
    return broken.select(ident, F.lit(relation.path).alias("path"), F.lit(relation.how).alias("fault"))


def resolved(values: DataFrame, ident: str, rules: Sequence[Rule]) -> DataFrame:
    """(ident, path, value) of all paths with a rule: what the document says, else the default.

    One pass over ``values``, and one shuffle by document.
    """
    said = F.when(F.col("path").isin(*[r.path for r in rules]) & (F.col("kind") != "null"), F.struct("path", "value"))
    held = values.groupBy(ident).agg(F.collect_list(said).alias("said"))
    fallbacks = [F.struct(F.lit(r.path).alias("path"), F.lit(r.default).alias("value")) for r in rules if r.default is not None]
    if not fallbacks:
        return held.select(ident, F.inline("said"))
    unsaid = F.filter(F.array(*fallbacks), lambda d: ~F.exists("said", lambda x: x["path"] == d["path"]))
    return held.select(ident, F.inline(F.concat("said", unsaid)))
