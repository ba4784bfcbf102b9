"""Shared helpers of the corpus operators: scratch tables, byte hashing, text blocks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only in local mode and if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file:///tmp/tarnwork-scratch-{os.getuid()}"
    return folder.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` through a Parquet table in the shared folder.

    One write, no second computation; a lost executor only re-reads the file.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnwork_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a table made by :func:`write_table` that nothing reads any more."""
    path = getattr(df, "_tarnwork_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession, at_least: int = 1) -> int:
    """The session's shuffle width, the number the cluster was sized for."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def apart(df: DataFrame, column: str) -> DataFrame:
    """``df``, an aggregate by a join key, dealt out by another column.

    An aggregate that is already partitioned by the key is joined where it lies, and then
    the adaptive skew join cannot split the other side. Dealt out anew, both sides of the
    join have an exchange of their own.
    """
    return df.repartition(column)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the graph of ``edges``; root is the smallest node reachable.

    Alternates large-star and small-star steps until the edge table is a fixed
    point; each one but the last lowers some label, so they end. A step is grouped minima
    (combined map side) and an equi join with them, dealt :func:`apart`, so that the
    adaptive skew join can split a hub with a third of all edges. Null ends are ignored;
    no edges give an empty table.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = write_table(cur, "cc")
    last = None
    while True:
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(apart(low, "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(apart(down, "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        nxt = write_table(small, "cc")
        sign = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(cur)
        cur = nxt
        if sign == last:
            break
        last = sign
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


# ---------------------------------------------------------------- byte hashing

_FIELD = np.uint64((1 << 31) - 1)  # a prime, so that few strings of one length share a value for a random base
_POWERS: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for any 64-bit x."""
    x = (x & _FIELD) + (x >> np.uint64(31))
    x = (x & _FIELD) + (x >> np.uint64(31))
    return np.where(x >= _FIELD, x - _FIELD, x)


def _running(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1), by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _reduced(out * np.uint64(pow(base, len(out), int(_FIELD))))])
    return out[:n]


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each byte, powers of a random base, powers of its inverse), at least n of them."""
    have = _POWERS.get(seed)
    if have is None or have[0] < n:
        rng = np.random.default_rng([20240817, seed])
        field, size = int(_FIELD), max(n, 1 << 20)
        base, byte = int(rng.integers(1 << 20, field - 1)), rng.permutation(256).astype(np.uint64) * np.uint64(8_000_009) + np.uint64(1)
        have = _POWERS[seed] = (size, byte, _running(base, size), _running(pow(base, -1, field), size))
    return have[1:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SpanHash:
    """62-bit hashes of any spans of one byte block, from two prefix sums, mixed to 64 bits.

    Each is a polynomial in a random base over the prime field of 2^31 - 1: two different
    strings of n bytes share both with a chance of (n / 2^31)^2 at most, whatever they are.
    Other seeds give independent hashes.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.parts = []
        for k in (2 * seed, 2 * seed + 1):
            byte, up, down = _powers(k, len(data) + 1)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_reduced(byte[data] * down[: len(data)]), out=sums[1:])  # below 2^64 for 2^33 bytes
            self.parts.append((sums, up))

    def _joined(self, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        high, low = (_reduced(_reduced(sums[end] - sums[start]) * up[at]) for sums, up in self.parts)
        return (high << np.uint64(32)) | low

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self._joined(start, end, start) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, q: int) -> np.ndarray:
        """The hash of the q bytes from each position at which q bytes remain."""
        n = len(self.parts[0][0]) - q
        return mix(self._joined(slice(0, n), slice(q, None), slice(0, n))) if n > 0 else np.zeros(0, np.uint64)


def text_blocks(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of runs of rows of about ``limit`` bytes.

    Rows are whole; a longer row stands alone. Null texts are empty. Offsets start
    at 0 in each block.
    """
    col = batch.column(batch.schema.get_field_index(text))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, ends, data = col.buffers()
    kind = np.int64 if wide else np.int32
    n = len(col)
    if n == 0:
        return
    offsets = np.frombuffer(ends, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, offsets[row : end + 1] - offsets[row], raw[offsets[row] : offsets[end]]
        row = end


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
