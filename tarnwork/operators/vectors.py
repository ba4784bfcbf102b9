"""Cosine nearest neighbours in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.columns import l2_normalised
from tarnwork.operators import tiles

SHARD = 65_536  # reference vectors a task, at most about
SLICE = 32_768  # query vectors a task, at most about
CELLS = 64  # slices by shards of a small search, so that all cores have some; four a core, if those are more
LEAST = 4_096  # query vectors a slice, at least, as far as slices are cut for the cores
_FOUND = "q_id LONG, ref_id LONG, sim DOUBLE"


def normalised(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, l2_normalised(F.col(vector)))


def _cut(queries: int, refs: int, cores: int) -> tuple[int, int]:
    """(slices, shards): every slice copies all references and every shard all queries, so there are no more than size and cores ask for."""
    shards = max(1, -(-refs // SHARD))
    return max(1, -(-queries // SLICE), min(-(-max(CELLS, 4 * cores) // shards), queries // LEAST)), shards


def _matrix(rows: pa.Table) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in rows.column("v").chunks] or [pa.array([], pa.float64())])
    return values.to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))


def nearest(queries: DataFrame, refs: DataFrame, k: int, exclude: str | None = None) -> DataFrame:
    """(q_id, ref_id, sim, rank): the k most similar references of each query.

    ``queries`` has q_id and v, ``refs`` ref_id and v; ties go to the smaller ref_id. A
    reference with the query's own id is left out; with ``exclude``, a column of both
    sides, so is one with the same value there (leave one group out in one pass).

    Queries and references are cut into slices and shards that grow in number, not in
    size; a task scores one slice against one shard, a :mod:`tile <tarnwork.operators.tiles>`
    at a time, and keeps k a query, and a window merges the shards. Nothing is broadcast, and a query filter
    belongs in front: it does not move through the ranking.
    """
    slices, shards = _cut(queries.count(), refs.count(), queries.sparkSession.sparkContext.defaultParallelism)
    tag = F.col(exclude).cast("string") if exclude else F.lit(None).cast("string")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = normalised(queries, "v").select(F.col("q_id").cast("long").alias("q_id"), tag.alias("tag"), "v", part("q_id", slices).alias("slice"), spread(shards).alias("shard"))
    r = normalised(refs, "v").select(F.col("ref_id").cast("long").alias("ref_id"), tag.alias("tag"), "v", part("ref_id", shards).alias("shard")).select("*", spread(slices).alias("slice"))

    def score(qs: pa.Table, rs: pa.Table) -> pa.Table:
        tags = [x.column("tag").to_numpy() for x in (qs, rs)] if exclude else [None, None]
        found = tiles.best(qs.column("q_id").to_numpy(), _matrix(qs), rs.column("ref_id").to_numpy(), _matrix(rs), k, *tags)
        return pa.table(dict(zip(("q_id", "ref_id", "sim"), found, strict=True)))

    best = q.groupBy("slice", "shard").cogroup(r.groupBy("slice", "shard")).applyInArrow(score, _FOUND)
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("sim"), "ref_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
