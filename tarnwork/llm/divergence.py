"""Source divergence audit: how far the terms of each source of a language are from the others'.

Every language keeps the terms that at least ``SUPPORT`` of its documents hold. With count n
of a term in a group, N of all kept terms there and V kept terms, p is
1 + floor(10^9 (n + 1) / (N + V)) and the divergence of p from q floor((p - q)^2 / q). A pair
of sources adds it up over all V terms, by inclusion and exclusion over the two supports:

- terms that one side has cost the same wherever their count is the same, so the histogram of
  a group's counts prices all its terms as if the other side had none of them;
- the terms that both have come from a join of postings, which adds what they cost and takes
  back the two one-sided prices;
- the terms that neither has cost a constant each, V less both supports plus the overlap.

All arithmetic is on whole numbers, exact for up to 9 * 10^13 terms a language.

Plan: a pass over the texts counts (language, source, term) inside blocks of text and deals
the counts, packed, by a hash of the term; one merge a shard adds them up and drops rare
terms. Above ``FAN`` pieces of a shard they are merged in rounds first, so that a term of
every block is not one task. Kept counts are written once; group sums, histograms and top
terms are plain aggregates and windows over them. Postings are packed by ``RANGE`` sources
of a term before they are joined by term; that join gives one row for each two ranges, and
the pairs inside are summed in the task that meets them. Nothing is broadcast by hand. The
result itself has a row for every two sources of a language, and nothing else grows so.

Edge cases: null text, language and source are empty strings. Rows that repeat a doc_id are
documents of their own. A group without kept terms has the smoothed share everywhere; with
V = 0 all pairs are 0. A language of one source has no pairs. Ties: item in UTF-8 order. Very
long texts are blocks of their own. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tarnwork.llm.common import LOWER, parallelism, text_blocks, write_table
from tarnwork.llm.words import distinct, spans, taken

SUPPORT = 3  # documents of a language that a kept term is in, at least
RANKS = 200  # of the terms of a group
BLOCK = 4 << 20  # bytes of text that are counted together
SHARD = 8 << 20  # bytes of text a shard of terms, about
FAN = 512  # packed pieces of a shard that one task merges
RANGE = 256  # sources in one packed posting

_IN_TERM = np.ones(256, dtype=bool)  # neither controls, digits, marks nor blanks: letters and all that is not ASCII
_IN_TERM[:0x41], _IN_TERM[0x5B:0x61], _IN_TERM[0x7B:0x80] = False, False, False

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PACKED = pa.schema([("shard", pa.int64()), ("piece", pa.int64()), ("counts", pa.binary())])
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("in_lang", pa.int64()), ("first", pa.bool_())])
_SPARK = {_PACKED: "shard LONG, piece LONG, counts BINARY", _KEPT: "lang STRING, source STRING, term STRING, n LONG, in_lang LONG, first BOOLEAN"}


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, n, size).astype(np.int64)  # exact below 2^53


def _merged(packed: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The packed counts of one shard, added up; and the (term, language) of each, as rising numbers."""
    rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed.column("counts")]).combine_chunks()
    names = [rows.column(c).dictionary_encode().combine_chunks() for c in ("term", "lang", "source")]
    codes = [x.indices.to_numpy().astype(np.int64) for x in names]
    langs, sources = max(1, len(names[1].dictionary)), max(1, len(names[2].dictionary))
    keys, at = np.unique((codes[0] * langs + codes[1]) * sources + codes[2], return_inverse=True)
    pair, source = np.divmod(keys, sources)
    of = [x.dictionary.take(pa.array(c)) for x, c in zip(names, (pair // langs, pair % langs, source), strict=True)]
    return pa.table([of[1], of[2], of[0], *(_sums(at, rows.column(c).to_numpy(), len(keys)) for c in ("n", "docs"))], schema=_COUNTS), pair


def _count_pass(shards: int) -> Callable:
    """(shard, piece, counts) of every block of (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        for batch in batches:
            for row, end, offsets, data in text_blocks(batch, "text", BLOCK):
                low = LOWER[data]
                start, stop, text = spans(low, offsets, _IN_TERM)
                code, first, hashes = distinct(low, start, stop)
                names, group = np.unique(np.stack([batch.column(c).slice(row, end - row).dictionary_encode().indices.to_numpy() for c in (0, 1)]), axis=1, return_inverse=True)
                langs, sources = (batch.column(c).slice(row, end - row).dictionary_encode().dictionary.take(pa.array(names[c])) for c in (0, 1))
                held, n = np.unique(text * len(first) + code, return_counts=True)  # by document and term
                of_doc, term = np.divmod(held, max(1, len(first)))
                met, at = np.unique(group.ravel()[of_doc] * len(first) + term, return_inverse=True)
                counts, docs = _sums(at, n, len(met)), np.bincount(at, minlength=len(met))
                place = (hashes % np.uint64(shards)).astype(np.int64)
                by_group, by_term = np.divmod(met, max(1, len(first)))
                words = taken(low, start[first[by_term]], stop[first[by_term]])
                rows = pa.table([langs.take(pa.array(by_group)), sources.take(pa.array(by_group)), words, counts, docs], schema=_COUNTS)
                shard = place[by_term]
                order = np.lexsort((by_group, by_term, shard))
                rows, shard = rows.take(pa.array(order)), shard[order]
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
                made = [(int(shard[a]), piece, _packed(rows.slice(a, b - a))) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], type=f.type) for i, f in enumerate(_PACKED)], schema=_PACKED)

    return run


def _combine(packed: pa.Table) -> pa.Table:
    one = packed.slice(0, 1)
    return pa.table([one.column("shard"), pa.array([one.column("piece")[0].as_py() // FAN]), pa.array([_packed(_merged(packed)[0])])], schema=_PACKED)


def _keep(packed: pa.Table) -> pa.Table:
    """(lang, source, term, n, in_lang, first) of the kept terms of one shard."""
    counts, pair = _merged(packed)
    new = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
    term = np.cumsum(new) - 1
    held, docs = (_sums(term, counts.column(c).to_numpy(), int(new.sum()))[term] for c in ("n", "docs"))
    out = pa.table([*(counts.column(c) for c in ("lang", "source", "term", "n")), held, new], schema=_KEPT)
    return out.filter(pa.array(docs >= SUPPORT))


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_lang, first) of documents (lang, source, text): n > 0 in the group, in_lang in the language.

    ``first`` marks one row of every kept (lang, term).
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(parallelism(docs.sparkSession), -(-size // SHARD))
    packed = texts.mapInArrow(_count_pass(shards), _SPARK[_PACKED])
    pieces = -(-size // BLOCK)
    while pieces > FAN:
        packed = packed.groupBy("shard", F.expr(f"piece div {FAN}")).applyInArrow(_combine, _SPARK[_PACKED])
        pieces //= FAN
    return packed.groupBy("shard").applyInArrow(_keep, _SPARK[_KEPT])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in two steps that stay inside 64 bits; null without terms."""
    whole = F.nullif(total + terms, F.lit(0))
    scaled = (n + 1) * 100_000
    return 1 + _div(scaled, whole) * 10_000 + _div(scaled % whole * 10_000, whole)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _overlap_pass(batches: Iterator[pa.RecordBatch], chunk: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) of joined postings: what terms of both a and b add to their one-sided prices, summed in chunks."""

    def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
        lists = batch.column(batch.schema.get_field_index(name))
        rows = lists.flatten()
        return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), [rows.field(f).to_numpy() for f in ("id", "p", "zero")]

    for batch in batches:
        lang = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
        of_row = lang.indices.to_numpy().astype(np.int64)
        (a_at, (a_id, a_p, a_zero)), (b_at, (b_id, b_p, b_zero)) = flat(batch, "a"), flat(batch, "b")
        wide = np.diff(b_at)
        upto = np.concatenate([[0], np.cumsum(np.diff(a_at) * wide)])
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(upto, upto[first] + chunk, side="right")) - 1)
            row = np.repeat(np.arange(first, end), upto[first + 1 : end + 1] - upto[first:end])
            turn = np.arange(upto[first], upto[end]) - upto[row]
            i, j = a_at[row] + turn // wide[row], b_at[row] + turn % wide[row]
            apart = a_id[i] != b_id[j]
            row, i, j = row[apart], i[apart], j[apart]
            extra = _cost(a_p[i], b_p[j]) - _cost(a_p[i], b_zero[j]) - _cost(a_zero[i], b_p[j]) + _cost(a_zero[i], b_zero[j])
            keys, at = np.unique(np.stack([of_row[row], a_id[i], b_id[j]]), axis=1, return_inverse=True) if len(row) else (np.zeros((3, 0), np.int64), row)
            value = np.zeros(keys.shape[1], np.int64)
            np.add.at(value, at.ravel(), extra)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(keys[0])), pa.array(keys[1]), pa.array(keys[2]), pa.array(value)], names=["lang", "a", "b", "value"])
            first = end


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, id, total, held, lang_total, terms, zero): a row for every occurring group."""
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    rows = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "held", "lang_total", "terms"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    return rows.withColumn("id", number).withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms")))


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text)."""
    kept = write_table(kept_terms(docs), "divergence-terms")
    groups = write_table(_groups(docs, kept), "divergence-groups")
    told = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    best = told.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= RANKS)

    posting = F.collect_list(F.struct("id", "p", "zero"))
    ranges = told.select("lang", "term", "id", "p", "zero").repartition("lang", "term").groupBy("lang", "term", _div(F.col("id"), F.lit(RANGE)).alias("range")).agg(posting.alias("postings"))
    met = ranges.select("lang", "term", F.col("postings").alias("a")).join(ranges.select("lang", "term", F.col("postings").alias("b")), ["lang", "term"])
    overlaps = met.select("lang", "a", "b").mapInArrow(_overlap_pass, "lang STRING, a LONG, b LONG, value LONG").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))

    counted = told.groupBy("lang", "id", "p").agg(F.count("*").alias("m"))
    prices = counted.groupBy("lang", "id").agg(F.collect_list(F.struct("p", "m")).alias("prices"))
    sides = groups.join(prices, ["lang", "id"], "left").select("lang", "source", "id", "terms", "held", "zero", "prices")
    side = lambda s: sides.select("lang", *[F.col(c).alias(f"{s}_{c}") for c in ("source", "id", "terms", "held", "zero", "prices")])
    pairs = side("a").join(side("b"), "lang").where("a_id <> b_id")
    pairs = pairs.join(overlaps.select("lang", F.col("a").alias("a_id"), F.col("b").alias("b_id"), "both"), ["lang", "a_id", "b_id"], "left")
    nothing = F.lit(0).cast("long")
    one_side = lambda prices, cost: F.aggregate(F.coalesce(prices, F.array().cast("ARRAY<STRUCT<p: BIGINT, m: BIGINT>>")), nothing, lambda acc, x: acc + x["m"] * cost(x["p"]))
    value = (
        one_side(F.col("a_prices"), lambda p: divergence(p, F.col("b_zero"))) + one_side(F.col("b_prices"), lambda p: divergence(F.col("a_zero"), p))
        + (F.col("a_terms") - F.col("a_held") - F.col("b_held")) * divergence(F.col("a_zero"), F.col("b_zero")) + F.coalesce(F.col("both"), nothing)
    )
    sums = pairs.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), F.coalesce(value, nothing).alias("value"))
    return sums.withColumn("rank", F.row_number().over(by_value)).unionByName(best)
