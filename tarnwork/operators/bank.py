"""A reference bank that is normalised, packed and bucketed once, for many searches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.operators import tiles
from tarnwork.operators.vectors import normalised
from tarnwork.sources.scratch import folder

BLOCK = 16_384  # reference vectors a block, at most about; every block copies all queries
SPREAD = 32  # blocks of a bank that has few rows, so that all cores search
LEAST = 4_096  # reference vectors a block, at least, as far as blocks are cut for the cores
SLICE = 8_192  # query vectors a block, at most about
_FOUND = "q_id LONG, ref_id LONG, sim DOUBLE"


@dataclass(frozen=True)
class Bank:
    """A table of blocks, bucketed by shard."""

    table: str
    shards: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)


def _packed(rows: DataFrame, ident: str, part: str) -> DataFrame:
    """(part, ids, tags, values) of (part, ident, tag, v): a block a part, in order of ident."""
    held = F.array_sort(F.collect_list(F.struct(ident, "tag", "v")))
    blocks = rows.groupBy(part).agg(held.alias("__b"))
    return blocks.select(part, F.col(f"__b.{ident}").alias("ids"), F.col("__b.tag").alias("tags"), F.flatten("__b.v").alias("values"))


def _part(ident: str, n: int):
    return F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")


def keep_bank(refs: DataFrame, tag: str | None = None) -> Bank:
    """Writes the normalised ``refs`` (ref_id, v) with an optional column to exclude by; blocks grow in number, not in size.

    The table lies in the shared folder and is bucketed by shard, so that searches join it
    where it lies.
    """
    spark = refs.sparkSession
    width, n = int(spark.conf.get("spark.sql.shuffle.partitions")), refs.count()
    shards = max(1, -(-n // BLOCK), min(width, SPREAD, n // LEAST))
    name = f"tarnwork_bank_{uuid.uuid4().hex}"
    rows = normalised(refs, "v").select(F.col("ref_id").cast("long").alias("ref_id"), (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"), "v", _part("ref_id", shards).alias("shard"))
    blocks = _packed(rows, "ref_id", "shard").select("shard", F.col("ids").alias("ref_ids"), F.col("tags").alias("ref_tags"), F.col("values").alias("refs"))
    blocks.write.bucketBy(width, "shard").sortBy("shard").option("path", f"{folder(spark)}/tarnwork-core/{name}").format("parquet").saveAsTable(name)
    return Bank(name, shards)


def _score(k: int, exclude: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                values = {n: c[i].values for n, c in at.items()}
                q_ids, ref_ids = (values[n].to_numpy(zero_copy_only=False) for n in ("ids", "ref_ids"))
                q, bank = (values[v].to_numpy(zero_copy_only=False).reshape(len(ids), -1) for v, ids in (("values", q_ids), ("refs", ref_ids)))
                tags = [np.array(values[n].to_pylist(), dtype=object) for n in ("tags", "ref_tags")] if exclude else [None, None]
                found = tiles.best(q_ids, q, ref_ids, bank, k, *tags)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["q_id", "ref_id", "sim"])

    return run


def nearest_kept(queries: DataFrame, bank: Bank, k: int, exclude: str | None = None) -> DataFrame:
    """(q_id, ref_id, sim, rank) as :func:`tarnwork.operators.vectors.nearest` gives it, from a kept bank.

    ``exclude`` is the queries' column that is held against the bank's tag. Only blocks of
    queries are shuffled, once a shard; a task scores one block against one other, by :mod:`tarnwork.operators.tiles`.
    """
    spark = queries.sparkSession
    slices = max(1, -(-queries.count() // SLICE))
    tag = (F.col(exclude) if exclude else F.lit(None)).cast("string")
    rows = normalised(queries, "v").select(F.col("q_id").cast("long").alias("q_id"), tag.alias("tag"), "v", _part("q_id", slices).alias("slice"))
    asked = _packed(rows, "q_id", "slice").select("*", F.explode(F.sequence(F.lit(0), F.lit(bank.shards - 1))).alias("shard"))
    met = asked.join(bank.blocks(spark), "shard").select("ids", "tags", "values", "ref_ids", "ref_tags", "refs")
    best = met.mapInArrow(_score(k, exclude is not None), _FOUND)
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("sim"), "ref_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
