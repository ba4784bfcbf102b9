"""Personal data: pattern spans, and terms that disclose them by corpus statistics.

Base spans are leftmost non-overlapping pattern matches of each kind, kept if they
validate. On top of these, information-theoretic sanitisation: every found value is a
protected entity e, and every word of three letters or more of a document that holds e is
a term t met with it, on whatever line and at whatever distance. Over all documents, with
n(.) the number of documents,

    PMI(t; e) = ln(n(t, e) * N / (n(t) * n(e))),   IC(e) = ln(N / n(e)),

and a term whose PMI reaches ``generalise`` of the information content of e gives that
share of e away: in every document that holds e, all its occurrences outside base spans
become ``term`` spans and are generalised; from ``remove`` on they are taken out. Every
pair is judged by its document counts alone: one joint document is evidence enough, and
so are many copies of one passage. As n(t, e) <= n(e), only terms with
n(t) <= N * (n(e) / N) ** generalise can reach the share; others make no pair.

Terms that lie in the very same documents have the same counts with every entity, and so
have entities with each other. They are counted as one class each, named by an exclusive-or
fingerprint of 128 bits over their documents: a text with 20,000 addresses and 20,000 rare
words makes one pair, and not 400 million.

Everything is DataFrame functions, and linear in a text. Positions come from lengths: the
pieces between matches (``split``) and the matches (``regexp_extract_all``) interleave, and
running sums are taken in blocks and over blocks. Text is cut through
chunks of 4,096 code points, so that no cut walks from its start. Patterns start only where
a run of their first character class starts or a match has just ended (``\\G``) and use
possessive repeats; both leave the matches as they are and keep long runs from costing
quadratic time or deep recursion. Told terms meet the words of a text by an equi join.

Edge cases: a null or empty text has no spans (its digest is that of the empty string).
Overlapping spans of several kinds are all reported; rewriting replaces their union
once. Rows that repeat a doc_id count as one document and share its disclosing terms. A
null doc_id has base spans only. Extra columns pass through :func:`sanitise`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import drop_table, text_or_empty, write_table

KINDS = ("email", "ip", "card", "phone", "term")
CHUNK = 4096  # code points a chunk of text
BLOCK = 128  # entries a block of a running sum

_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GAP = r"[^\p{L}\p{N}]+"
_MASK = "\x00"  # stands for every letter and digit of a base span while words are sought
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_REGION = "array<struct<prev:int,start:int,end:int,kind:int,value:string>>"


# ---------------------------------------------------------------- arrays and text
# Steps are columns of their own (``__`` names) and lambdas stay shallow: every level of
# nested lambdas costs the analyzer one more round.


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where a lambda uses it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none(kind: str) -> Column:
    return F.expr(f"CAST(array() AS {kind})")


def with_running(df: DataFrame, names: list[str], join: Callable[[Column, Column], Column]) -> DataFrame:
    """For each int array x of ``names``, ``x_run``: what ``join`` makes of 0 and all entries before each entry, and of all at the end.

    Blocks are folded, the folds run, and each block goes on from its fold, so that an
    entry is copied within a block only, however long the array is.
    """
    def within(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), _none("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocks(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))).otherwise(_none("array<int>"))
        return F.transform(starts, lambda i: F.slice(v, i, BLOCK))

    df = df.withColumns({f"__b_{x}": _let(F.col(x), blocks) for x in names})
    df = df.withColumns({f"__f_{x}": within(F.transform(f"__b_{x}", lambda b: F.aggregate(b, F.lit(0), join)), F.lit(0)) for x in names})
    runs = {f"{x}_run": F.concat(F.flatten(F.zip_with(f"__b_{x}", f"__f_{x}.out", lambda b, s: within(b, s)["out"])), F.array(f"__f_{x}.at")) for x in names}
    return df.withColumns(runs).drop(*(f"__{k}_{x}" for k in "bf" for x in names))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}+" % CHUNK), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start..end (exclusive) of a text in chunks."""
    def part(i: Column) -> Column:
        a, b = F.greatest(start - i * CHUNK, F.lit(0)), F.least(end - i * CHUNK, F.lit(CHUNK))
        return F.substring(F.get(chunks, i), a + 1, b - a)

    at = lambda x: F.floor(x / CHUNK).cast("int")
    return F.when(start < end, F.array_join(F.transform(F.sequence(at(start), at(end - 1)), part), "")).otherwise(F.lit(""))


# ---------------------------------------------------------------- base spans


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        def small(p: Column) -> Column:
            p = F.regexp_replace(p, "^0+", "")
            return (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(x, r"\."), small)
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        def worth(c: Column, i: Column) -> Column:
            d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return F.when(d > 9, d - 9).otherwise(d)

        each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), worth)
        luhn = F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0
        return F.when(F.length(digits).between(12, 19), luhn).otherwise(False)
    return F.lit(True)


def _with_matches(df: DataFrame, found: dict[str, tuple[Column, int, Callable[[Column], Column]]]) -> DataFrame:
    """For each name, the spans of the (gap, match) pairs that ``keep`` accepts, in order, from their (pairs, kind, keep)."""
    pairs = {f"__p_{n}": p for n, (p, _, _) in found.items()}
    df = df.withColumns(pairs).withColumns({f"__w_{n}": F.transform(f"__p_{n}", lambda p: p["w"]) for n in found})
    df = with_running(df, [f"__w_{n}" for n in found], lambda a, x: a + x)

    def spans(n: str, kind: int, keep: Callable[[Column], Column]) -> Column:
        one = lambda p, at: F.struct((at + p["g"]).alias("start"), F.lit(kind).alias("kind"), (at + p["w"]).alias("end"), p["m"].alias("value"))
        return F.filter(F.zip_with(f"__p_{n}", f"__w_{n}_run", one), lambda s: s["value"].isNotNull() & keep(s["value"]))

    df = df.withColumns({n: spans(n, kind, keep) for n, (_, kind, keep) in found.items()})
    return df.drop(*pairs, *(f"__w_{n}{end}" for n in found for end in ("", "_run")))


def _pairs(text: Column, pattern: str) -> Column:
    """The pieces between matches with the matches that follow them: g (length), w (of both), m."""
    def sized(g: Column, m: Column) -> Column:
        return F.struct(F.length(g).alias("g"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("w"), m.alias("m"))

    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), sized)


def with_base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: all valid base spans of the non-null column ``text``, by start and then kind."""
    t = F.col(text)
    maybe = {
        "email": F.contains(t, F.lit("@")),
        "ip": t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": F.contains(t, F.lit("+")),
    }
    none = _none("array<struct<g:int,w:int,m:string>>")
    found = {f"__{k}": (F.when(maybe[k], _pairs(t, _PATTERN[k])).otherwise(none), i, lambda m, k=k: _valid(k, m)) for i, k in enumerate(KINDS[:4])}
    return _with_matches(df, found).withColumn(out, F.sort_array(F.concat(*found))).drop(*found)


def with_regions(df: DataFrame, spans: str, out: str) -> DataFrame:
    """``out``: unions of overlapping sorted spans, with the end of the one before and the first span's kind and value."""
    df = with_running(df.withColumn("__ends", F.transform(spans, lambda s: s["end"])), ["__ends"], lambda a, x: F.greatest(a, x))
    each = F.zip_with(spans, "__ends_run", lambda s, e: F.struct(e.alias("prev"), s["start"].alias("start"), s["kind"].alias("kind"), s["value"].alias("value")))
    df = df.withColumn("__first", F.filter(each, lambda r: r["start"] >= r["prev"]))
    df = df.withColumn("__last", F.concat(F.transform(F.slice("__first", F.lit(2), F.size("__first")), lambda r: r["prev"]), F.slice("__ends_run", F.lit(-1), F.lit(1))))
    closed = F.zip_with("__first", "__last", lambda r, e: F.struct(r["prev"].alias("prev"), r["start"].alias("start"), e.alias("end"), r["kind"].alias("kind"), r["value"].alias("value")))
    return df.withColumn(out, F.when(F.size("__first") > 0, closed).otherwise(_none(_REGION))).drop("__ends", "__ends_run", "__first", "__last")


def with_rewritten(df: DataFrame, text: str, spans: str, out: str, said: Callable[[Column, Column], Column]) -> DataFrame:
    """``out``: ``text`` with ``said(chunks, region)`` in the place of every region of ``spans``."""
    df = with_regions(df, spans, "__regions").withColumn("__chunks", F.when(F.size("__regions") > 0, _chunks(F.col(text))))

    def written(chunks: Column) -> Column:
        parts = F.transform("__regions", lambda r: F.concat(_cut(chunks, r["prev"], r["start"]), said(chunks, r)))
        return F.concat(F.array_join(parts, ""), _cut(chunks, F.element_at("__regions", -1)["end"], F.length(text)))

    new = F.when(F.size("__regions") > 0, _let(F.col("__chunks"), written)).otherwise(F.col(text))
    return df.withColumn(out, new).drop("__regions", "__chunks")


# ---------------------------------------------------------------- terms


def _is_term(w: Column) -> Column:
    return w.rlike(r"^\p{L}") & (F.length(w) >= 3)


def _terms(text: Column) -> Column:
    """The distinct terms of a text; each word is lower-cased by itself, as in its span."""
    return F.array_distinct(F.transform(F.filter(F.array_distinct(F.split(text, _GAP)), _is_term), F.lower))


def with_words_outside(df: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """``out``: start, end and term of the words of ``text`` that do not overlap any of ``spans``.

    Letters and digits of spans become a mark that joins on to words, so that a word that
    overlaps a span holds the mark and one that only touches it does not.
    """
    hidden = lambda chunks, r: F.regexp_replace(_cut(chunks, r["start"], r["end"]), r"[\p{L}\p{N}]", _MASK)
    df = with_rewritten(df.withColumn("__clean", F.translate(text, _MASK, " ")), "__clean", spans, "__masked", hidden)
    keep = lambda w: ~F.contains(w, F.lit(_MASK)) & _is_term(w)
    df = _with_matches(df, {"__found": (_pairs(F.col("__masked"), r"[\p{L}\p{N}\x00]++"), 4, keep)})
    words = F.transform("__found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("t")))
    return df.withColumn(out, words).drop("__clean", "__masked", "__found")


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, entities, terms) of every row; terms only where spans are.

    ``key`` is a hash of the text: rows of one doc_id and one text have the same spans.
    """
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    one = with_base_spans(one, "text", "spans")
    entity = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"])))))
    terms = F.when(F.size("spans") > 0, _terms(F.col("text"))).otherwise(_none("array<string>"))
    return one.select("doc_id", F.xxhash64("text").alias("key"), "spans", entity.alias("entities"), terms.alias("terms"))


def _by_document(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """(doc_id, t) of the terms of ``rows``, once a document; ``again``: the doc_ids of several rows."""
    def terms(some: DataFrame) -> DataFrame:
        return some.select("doc_id", F.explode(_terms(text_or_empty())).alias("t"))

    if again is None:
        return terms(rows)
    return terms(rows.join(again, "doc_id", "left_anti")).unionAll(terms(rows.join(again, "doc_id", "left_semi")).distinct())


def _counted(pairs: DataFrame, what: str) -> DataFrame:
    """Of distinct (doc_id, what): the number of documents and their fingerprint (two halves)."""
    half = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "doc_id"))
    return pairs.groupBy(what).agg(F.count("*").alias(f"n_{what}"), half(1).alias(f"{what}1"), half(2).alias(f"{what}2"))


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """(doc_id, t, gone): the terms that disclose an entity of the document, each with whether it goes."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = write_table(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "pii-ids")
    n_docs, n_again = ids.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    again = ids.where("n > 1").select("doc_id") if n_again else None
    known = found.where("doc_id IS NOT NULL AND size(spans) > 0")
    held = known.select("doc_id", F.explode("entities").alias("e")).distinct()
    n_e = _counted(held, "e").where(F.col("n_e") < n_docs)
    # the largest n_t with which a pair can reach the share, with room for rounding
    most = F.lit(float(n_docs)) * F.pow(F.col("n_e") / F.lit(float(n_docs)), F.lit(generalise)) * (1 + 1e-9)
    held = write_table(held.join(n_e.withColumn("most", most), "e").select("doc_id", "e1", "e2", "n_e", "most").distinct(), "pii-entities")
    top = held.agg(F.max("most")).first()[0] or 0.0
    near = known.select("doc_id", F.explode("terms").alias("t"))
    if again is not None:  # rows without spans add to the terms of their document
        near = near.unionAll(_by_document(rows.join(again, "doc_id", "left_semi"), again)).distinct()
    n_t = _counted(_by_document(rows, again), "t").where(F.col("n_t") <= top)
    near = write_table(near.join(n_t, "t"), "pii-terms")
    term, entity = ["t1", "t2", "n_t"], ["e1", "e2", "n_e"]
    pairs = near.select("doc_id", *term).distinct().join(held, "doc_id").where(F.col("n_t") <= F.col("most")).select("doc_id", *term, *entity)
    pairs = write_table(pairs, "pii-pairs")

    n_te = pairs.groupBy(*term, *entity).agg(F.count("*").alias("n_te"))
    share = F.log(F.col("n_te") * F.lit(float(n_docs)) / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(float(n_docs)) / F.col("n_e"))
    told = n_te.withColumn("share", share).where(F.col("share") >= generalise).select(*term, *entity, (F.col("share") >= remove).alias("gone"))
    told = pairs.join(told, [*term, *entity]).groupBy("doc_id", *term).agg(F.max("gone").alias("gone"))
    told = write_table(near.join(told, ["doc_id", *term]).select("doc_id", "t", "gone"), "pii-told")
    for used in (ids, held, near, pairs):
        drop_table(used)
    return told


def term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, key, terms): the told terms of a document wherever they stand in its texts, outside base spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    rows = with_base_spans(rows.join(told.select("doc_id").distinct(), "doc_id", "left_semi"), "text", "spans")
    # outer: for a plain one Spark would push "words is not empty" through every step above it
    words = with_words_outside(rows, "text", "spans", "words").select("doc_id", F.xxhash64("text").alias("key"), "words")
    words = words.select("doc_id", "key", F.inline_outer("words"))  # not one select: every word would carry the text
    span = F.struct("start", F.lit(4).alias("kind"), "end", F.when(F.col("gone"), "gone").otherwise("kept").alias("value"))
    # a set, for rows that repeat a doc_id and a text
    return words.join(told, ["doc_id", "t"]).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(span)).alias("terms"))


def _terms_or_none() -> Column:
    return F.coalesce("terms", _none(_SPAN))


def find_spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, terms) of every row; base and terms are arrays of spans."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = write_table(find_base(plain), "pii-base")
    terms = term_spans(plain, disclosing_terms(plain, base, **options))
    both = base.select("doc_id", "key", F.col("spans").alias("base")).join(terms, ["doc_id", "key"], "left")
    return both.select("doc_id", "base", _terms_or_none().alias("terms"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans."""
    found = find_spans(docs, **options)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(i).eqNullSafe)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    every = F.sort_array(F.concat("base", "terms"))
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(every).alias("spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span in ``text`` generalised to its kind or removed."""
    plain = docs.drop("terms", *(c for c in docs.columns if c.startswith("__"))).withColumn("text", F.col("text").cast("string"))
    base = write_table(find_base(plain), "pii-base")
    terms = term_spans(plain, disclosing_terms(plain, base, **options)).withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(text_or_empty()) == F.col("__key"))
    both = with_base_spans(plain.join(terms, same, "left").withColumn("__text", text_or_empty()), "__text", "__base")
    both = both.withColumn("__spans", F.sort_array(F.concat("__base", _terms_or_none())))
    label = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def said(_: Column, r: Column) -> Column:
        return F.when((r["kind"] == 4) & r["value"].eqNullSafe("gone"), F.lit("")).otherwise(F.element_at(label, r["kind"] + 1))

    new = with_rewritten(both, "text", "__spans", "__new", said)
    return new.withColumn("text", F.col("__new")).select(*plain.columns)
