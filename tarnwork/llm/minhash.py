"""MinHash near-dedup: circulant signatures, banding, exact Jaccard confirmation.

A document's set is its distinct five-word shingles (words ``[^\\x20\\x09-\\x0D]+``,
A-Z lower-cased; fewer words: the whole sequence; none: empty). Two permutations of a
fixed universe make the whole signature: ``sigma`` scatters a shingle's slot, and
coordinate k is the least entry of ``pi`` shifted circularly by k, so the K values of
one shingle are K neighbouring entries of ``pi``.

Plan: one Arrow pass makes set fingerprint and band keys; equal sets collapse to
their smallest doc_id; bands give buckets; each document is first compared with one
leader of its buckets, and after components are known only members of *different*
components that share a bucket are still compared, and of those only the ones whose
bitmaps leave room for the similarity (an upper bound, so no link is lost). Every link
is confirmed on the full shingle sets. No bucket is expanded to pairs of documents already known to be
connected, so a large group of near copies costs one comparison a document.

Edge cases: null or word-less text has an empty set, links with nothing and is kept.
A null doc_id takes no part in links: component_id is null, kept is true. Rows that
repeat a doc_id are separate rows; their links count for the id. Extra columns are
ignored. An empty table gives an empty result. Texts of millions of different shingles
fill the universe's 2^20 slots, so that they share all bands; they are still told apart
by size, bitmap and the exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import IS_SPACE, LOWER, apart, arrow_batch, connected_components, drop_table, mix, text_blocks, write_table
from tarnwork.llm.words import hashes as word_hashes

UNIVERSE = 1 << 20
BANDS, ROWS = 50, 5  # a pair at 0.75 shares no band with probability (1 - 0.75**5)**50, 1e-6

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary()), ("sketch", pa.list_(pa.int64()))])
SKETCH = 16  # 64-bit words of the bitmap that bounds intersections from above


class CirculantMinHash:
    """sigma and pi over the universe; ``pi`` is extended so that shifts need no modulo."""

    def __init__(self, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k = k
        self.sigma = rng.permutation(UNIVERSE).astype(np.int32)
        pi = rng.permutation(UNIVERSE).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.sigma[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        out = np.full(self.k, UNIVERSE, dtype=np.int32)
        for i in range(0, len(at), 2048):
            np.minimum(out, self.windows[at[i : i + 2048]].min(axis=0), out=out)
        return out


def shingle_sets(batch: pa.RecordBatch, words: int, text: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row of a batch."""
    weights = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    for first, end, offsets, data in text_blocks(batch, text):
        data = LOWER[data]
        word = np.concatenate([[False], ~IS_SPACE[data], [False]])
        fresh = np.zeros(len(data) + 1, dtype=bool)
        fresh[offsets] = True
        body = word[1:-1]
        starts = np.flatnonzero(body & (~word[:-2] | fresh[:-1]))
        ends = np.flatnonzero(body & (~word[2:] | fresh[1:])) + 1
        hashes = word_hashes(data, starts, ends)
        at = np.searchsorted(starts, offsets)
        with np.errstate(over="ignore"):
            n = len(hashes) - words + 1
            grams = mix(sum((hashes[i : n + i] * weights[i] for i in range(words)), np.zeros(max(n, 0), np.uint64))) if n > 0 else hashes[:0]
            for row in range(first, end):
                lo, hi = at[row - first], at[row - first + 1]
                if hi - lo >= words:
                    yield row, np.unique(grams[lo : hi - words + 1])
                elif hi > lo:
                    yield row, mix(np.array([(hashes[lo:hi] * weights[: hi - lo]).sum() + np.uint64(hi - lo)], dtype=np.uint64))
                else:
                    yield row, hashes[:0]


def _signature_pass(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = CirculantMinHash(bands * rows)
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(11))
        mult = mix(np.arange(rows, dtype=np.uint64) + np.uint64(101)) | np.uint64(1)
        for batch in batches:
            n, fps, keys = [], [], []
            for _, s in shingle_sets(batch, words):
                n.append(len(s))
                if len(s):
                    sig = maker.signature(s).astype(np.uint64).reshape(bands, rows)
                    keys.append(mix((sig * mult).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                    fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                else:
                    keys.append(None)
                    fps.append(None)
            yield arrow_batch(_SIGNATURE, [batch.column(0), n, fps, keys])

    return run


def _set_pass(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch, words)]
            yield arrow_batch(_SETS, [batch.column(0), [s.tobytes() for s in sets], [bitmap(s) for s in sets]])

    return run


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit a shingle. A bit set in x but not in y is a shingle that y lacks, so
    |x and y| <= |x| - popcount(x & ~y), whatever collides."""
    out = np.zeros(SKETCH, dtype=np.uint64)
    bit = (shingles >> np.uint64(40)) & np.uint64(64 * SKETCH - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def _can_reach(percent: int, na: str, nb: str, a: str, b: str) -> Column:
    """Whether the bitmaps leave room for the wanted similarity: never false for a link."""
    both = " + ".join(f"bit_count({a}[{i}] & {b}[{i}])" for i in range(SKETCH))
    most = f"least({na} - p{a}, {nb} - p{b}) + {both}"  # p: bits set in each
    return F.expr(f"(100 + {percent}) * ({most}) >= {percent} * ({na} + {nb})")


def _confirm(percent: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            keep = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                both = np.concatenate([np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y)])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([a, b], schema=out).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = write_table(docs.mapInArrow(_signature_pass(words, bands, rows), "doc_id long, n_shingles long, fp binary, bands array<long>"), "minhash")
    reps = base.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"))

    leaders = base.where("doc_id IS NOT NULL").join(reps.select(F.col("rep").alias("doc_id"), F.col("fp").alias("rfp")), "doc_id")
    keyed = leaders.where("fp = rfp").select("doc_id", "n_shingles", F.explode("bands").alias("h"))
    shared = keyed.groupBy("h").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("tail")).where("lead <> tail")
    members = write_table(keyed.join(shared, "h"), "minhash-buckets")

    wanted = members.select("doc_id").distinct()
    sets = write_table(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_set_pass(words), "doc_id long, shingles binary, sketch array<long>"), "minhash-sets")
    size = members.select("doc_id", "n_shingles").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
        return both.mapInArrow(_confirm(percent), "a long, b long")

    def fits(x: str, y: str):
        return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")

    # First round: one leader a document, the smallest over its buckets.
    first = members.where("doc_id <> lead").groupBy("doc_id", "n_shingles").agg(F.min("lead").alias("a")).withColumnRenamed("doc_id", "b")
    first = first.join(size.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na")), "a").where(fits("na", "n_shingles"))
    links = write_table(confirmed(first.select("a", "b")), "minhash-links")

    # Second round: buckets that still hold several components, against their last member.
    # Third round: what is left, every pair of one bucket across components.
    for final in (False, True):
        roots = write_table(connected_components(links), "minhash-roots")
        here = members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        here = here.select("h", "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("root"))
        mixed = here.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct("root", "doc_id", "n_shingles")).alias("z")).where("r0 <> r1")
        open_ = here.join(mixed.select("h", "z"), "h")
        if final:
            # Once a document, then a row a bucket; a pair is compared in the first open bucket it shares.
            each = open_.groupBy("doc_id", "n_shingles", "root").agg(F.sort_array(F.collect_set("h")).alias("hs")).join(sets.select("doc_id", "sketch"), "doc_id")
            each = each.withColumn("p", F.expr(" + ".join(f"bit_count(sketch[{i}])" for i in range(SKETCH)))).withColumn("h", F.explode("hs"))
            x = each.select("h", F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("p").alias("psa"), F.col("hs").alias("ha"))
            y = each.select("h", F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col("p").alias("psb"), F.col("hs").alias("hb"))
            near = (F.col("ra") < F.col("rb")) & fits("na", "nb") & _can_reach(percent, "na", "nb", "sa", "sb")
            pairs = x.join(y, "h").where(near & (F.array_min(F.array_intersect("ha", "hb")) == F.col("h"))).select("a", "b").distinct()
        else:
            pairs = (
                open_.where(F.col("root") != F.col("z.root")).where(fits("n_shingles", "z.n_shingles"))
                .groupBy(F.col("doc_id").alias("b")).agg(F.max("z.doc_id").alias("a")).select("a", "b")
            )
        more = write_table(links.unionAll(confirmed(pairs)), "minhash-links")
        drop_table(links)
        drop_table(roots)
        links = more
    roots = write_table(connected_components(links), "minhash-roots")
    for used in (links, sets, members):
        drop_table(used)

    # Texts without words stay out of the join: they share no set, and would share a task.
    named = base.where("fp IS NOT NULL").select("doc_id", "n_shingles", "fp").join(apart(reps, "rep"), "fp", "left")
    named = named.join(apart(roots, "root").withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", "rep", "root")
    none = F.lit(None).cast("long")
    out = named.unionAll(base.where("fp IS NULL").select("doc_id", "n_shingles", none.alias("rep"), none.alias("root")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, all columns unchanged.

    Of rows that repeat a doc_id with equal sets, all stay or go together.
    """
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
