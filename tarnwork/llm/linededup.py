"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of
at least ``min_chars`` code points that at least ``min_docs`` documents hold are
*repeated*; their lines stay only in the largest doc_id that holds them.

:class:`LineIndex` keeps three tables: postings (key, doc_id), exact reference counts
(key, n_docs, last_doc) and one cuckoo filter a shard over the repeated keys. Inserting
documents adds postings, adds to the counts and puts keys that reach ``min_docs`` in
their filter; deleting documents takes all of that back, fingerprint by fingerprint, so
insert followed by delete restores every later decision. A filter only thins out the
postings that must meet the exact table: it has no false negatives, and the counts
decide. Filters are read in (shard, salt) groups, a salt being a hash of the document.
A shard has as many salts as its share of the postings asks for, so groups and copies of
filters grow with the postings and not with the square of the shards, and a line held by
a third of all documents is spread over the many salts of its shard.

Edge cases: a null or empty text is one empty line and stays as it is. Rows with a null
doc_id hold no references and stay whole. Rows that repeat a doc_id count once for a
key and lose the same keys. Extra columns pass through. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import mix, parallelism, write_table

_KEYS = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
_SLOTS, _KICKS = 4, 500
GROUP = 500_000  # postings that meet one filter in a task


# ---------------------------------------------------------------- cuckoo filter


class CuckooFilter:
    """16-bit fingerprints in buckets of four, partial-key cuckoo hashing."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (_SLOTS * 0.8)))))
        return cls(np.zeros((buckets, _SLOTS), dtype=np.uint16))

    @classmethod
    def loads(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, dtype=np.uint16).reshape(-1, _SLOTS).copy())

    def dumps(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray):
        fp = (mix(k2.astype(np.int64).view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (mix(k1.astype(np.int64).view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)
        return fp, one, one ^ self._jump(fp)

    def _jump(self, fp) -> np.ndarray:
        return (mix(np.asarray(fp).astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(k1, k2)
        return ((self.slots[one] == fp[:, None]) | (self.slots[two] == fp[:, None])).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if some fingerprint found no slot; the filter is then to be rebuilt."""
        rng = np.random.default_rng(5)
        for fp, one, two in zip(*self._places(k1, k2), strict=True):
            at = one
            for tries in range(_KICKS):
                for place in (one, two) if tries == 0 else (at,):
                    free = np.flatnonzero(self.slots[place] == 0)
                    if len(free):
                        self.slots[place, free[0]] = fp
                        break
                else:
                    at = two if tries == 0 else at
                    turn = int(rng.integers(_SLOTS))
                    fp, self.slots[at, turn] = self.slots[at, turn], fp
                    at = int(at ^ self._jump(np.array([fp]))[0])
                    continue
                break
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for fp, one, two in zip(*self._places(k1, k2), strict=True):
            for place in (one, two):
                held = np.flatnonzero(self.slots[place] == fp)
                if len(held):
                    self.slots[place, held[0]] = 0
                    break


# ---------------------------------------------------------------- line keys


def line_keys(raw: bytes, min_chars: int) -> list[bytes | None]:
    """The key of every line; None for lines too short to count."""
    keys: list[bytes | None] = []
    for line in raw.split(b"\n"):
        key = line.strip().lower()  # bytes: ASCII white space and letters only
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        keys.append(key if long_enough else None)
    return keys


def _halves(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    one, two = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


def _posting_pass(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ones, twos = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc is None or not text.is_valid:
                    continue
                keys = {k for k in line_keys(text.as_buffer().to_pybytes(), min_chars) if k is not None}
                ids += [doc] * len(keys)
                for k in keys:
                    one, two = _halves(k)
                    ones.append(one)
                    twos.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, ones, twos)], schema=_KEYS)

    return run


def postings_of(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Distinct (doc_id, k1, k2) of the long enough lines of every document."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(_posting_pass(min_chars), "doc_id long, k1 long, k2 long")


# ---------------------------------------------------------------- the index


@dataclass
class LineIndex:
    postings: DataFrame
    counts: DataFrame  # k1, k2, n_docs, last_doc
    filters: DataFrame  # shard, slots
    shards: int
    min_docs: int = 3
    min_chars: int = 20

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, shards: int | None = None) -> LineIndex:
        shards = shards or parallelism(docs.sparkSession, 16)
        postings = write_table(postings_of(docs, min_chars), "line-postings").distinct()
        counts = write_table(_count(postings), "line-counts")
        index = cls(postings, counts, None, shards, min_docs, min_chars)
        index.filters = index._fresh_filters(counts)
        return index

    def _fresh_filters(self, counts: DataFrame) -> DataFrame:
        def make(keys: pd.DataFrame) -> pd.DataFrame:
            k1, k2 = keys.k1.to_numpy(), keys.k2.to_numpy()
            room = len(keys)
            while True:
                f = CuckooFilter.sized(room)
                if f.insert(k1, k2):
                    return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "slots": [f.dumps()]})
                room *= 2

        repeated = counts.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", self._shard())
        return write_table(repeated.groupBy("shard").applyInPandas(make, "shard int, slots binary"), "line-filters")

    def _shard(self):
        return F.pmod(F.xxhash64("k1", "k2"), F.lit(self.shards)).cast("int").alias("shard")

    def _moved(self, counts: DataFrame, postings: DataFrame) -> LineIndex:
        """The index after the counts changed: only keys that crossed ``min_docs`` touch a filter."""
        was = self.counts.select("k1", "k2", (F.col("n_docs") >= self.min_docs).alias("was"))
        now = counts.select("k1", "k2", (F.col("n_docs") >= self.min_docs).alias("now"))
        crossed = was.join(now, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))
        crossed = crossed.where("was <> now").select("k1", "k2", "now", self._shard())

        def update(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            shard = (held if len(held) else keys)["shard"].iloc[0]
            f = CuckooFilter.loads(held.slots.iloc[0]) if len(held) else CuckooFilter.sized(len(keys))
            gone, new = keys[~keys.now], keys[keys.now]
            f.delete(gone.k1.to_numpy(), gone.k2.to_numpy())
            full = not f.insert(new.k1.to_numpy(), new.k2.to_numpy())
            return pd.DataFrame({"shard": [shard], "slots": [None if full else f.dumps()]})

        filters = write_table(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, "shard int, slots binary"), "line-filters")
        out = LineIndex(postings, counts, filters, self.shards, self.min_docs, self.min_chars)
        full = filters.where("slots IS NULL").select("shard")
        if not full.isEmpty():  # these shards are rebuilt from the exact counts
            again = out._fresh_filters(counts.withColumn("shard", self._shard()).join(full, "shard", "left_semi").drop("shard"))
            out.filters = filters.where("slots IS NOT NULL").unionAll(again)
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with ``docs`` added; documents it already holds add nothing."""
        new = write_table(postings_of(docs, self.min_chars), "line-postings").distinct()
        new = new.join(self.postings, ["doc_id", "k1", "k2"], "left_anti")
        counts = self.counts.unionByName(_count(new)).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return self._moved(write_table(counts, "line-counts"), write_table(self.postings.unionByName(new), "line-postings"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of ``doc_ids`` (column doc_id)."""
        ids = doc_ids.select("doc_id").distinct()
        stay = write_table(self.postings.join(ids, "doc_id", "left_anti"), "line-postings")
        hit = self.postings.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct()
        again = _count(stay.join(hit, ["k1", "k2"], "left_semi"))
        counts = self.counts.join(hit, ["k1", "k2"], "left_anti").unionByName(again)
        return self._moved(write_table(counts, "line-counts"), stay)

    def dropped(self, group: int = GROUP) -> DataFrame:
        """(doc_id, drops): of every indexed document that loses lines, the keys they have.

        ``group``: postings of a shard that meet its filter in one task, at most about; a
        shard of more than twice the average is cut as well.
        """
        sizes = self.counts.groupBy(self._shard()).agg(F.sum("n_docs").alias("n"))  # one row a shard
        even = 2 * F.sum("n").over(Window.partitionBy(F.lit(0))) / self.shards
        sizes = F.broadcast(sizes.select("shard", F.ceil(F.col("n") / F.least(even, F.lit(group))).cast("int").alias("salts")))
        filters = self.filters.join(sizes, "shard").select("shard", "slots", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        asked = self.postings.select("doc_id", "k1", "k2", self._shard()).join(sizes, "shard")
        asked = asked.select("doc_id", "k1", "k2", "shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))

        def probe(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(keys):
                return keys.iloc[:0][["doc_id", "k1", "k2"]]
            hit = CuckooFilter.loads(held.slots.iloc[0]).contains(keys.k1.to_numpy(), keys.k2.to_numpy())
            return keys.loc[hit, ["doc_id", "k1", "k2"]]

        maybe = asked.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(probe, "doc_id long, k1 long, k2 long")
        exact = self.counts.where(F.col("n_docs") >= self.min_docs)
        lost = maybe.join(exact, ["k1", "k2"]).where("doc_id <> last_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drops"))


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


# ---------------------------------------------------------------- rewriting texts


def _rewrite_pass(min_chars: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column("text"), batch.column("__drops"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n_lines.append(raw.count(b"\n") + 1)
                gone = 0
                if drops.is_valid:
                    keys = {(x["k1"], x["k2"]) for x in drops.as_py()}
                    lines = raw.split(b"\n")
                    kept = [line for line, k in zip(lines, line_keys(raw, min_chars), strict=True) if k is None or _halves(k) not in keys]
                    gone = len(lines) - len(kept)
                    raw = b"\n".join(kept)
                n_dropped.append(gone)
                texts.append(raw if text.is_valid else None)
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], names=columns)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines, n_dropped."""
    plain = docs.drop("n_lines", "n_dropped", "__drops", "__doc")
    plain = plain.withColumn("text", F.col("text").cast("string"))
    drops = LineIndex.build(plain, min_docs, min_chars).dropped().select(F.col("doc_id").alias("__doc"), F.col("drops").alias("__drops"))
    both = plain.join(drops, F.col("doc_id").cast("long") == F.col("__doc"), "left").drop("__doc")
    columns = [*plain.columns, "n_lines", "n_dropped"]
    schema = plain.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).select(*columns).schema
    return both.mapInArrow(_rewrite_pass(min_chars, columns), schema)
