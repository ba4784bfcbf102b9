"""Exact top-k inner product: block-at-a-time pruning over document-range blocks.

Vectors become integers floor(scale * x). Documents are cut into blocks of neighbouring
ids; a block carries a forward index (its id and value matrix) and, for every term (a
dimension), its largest and smallest value. A query's bound for a block is the sum over
terms of the best product that the block allows. Blocks are taken in falling order of
bound; scoring stops for a query once the next bound is below its kth score so far.
Bounds equal to it are still scored, so ties are complete and the result is exact.

Plan: blocks are dealt to shards and queries to slices; a (slice, shard) pair is one
bounded task, since shards and slices grow in number and not in size. Every task
returns k rows a query, which a grouped top-k then merges. Nothing is broadcast. The
stated queries meet all rows in blocks; no row pairs are made.

Edge cases: vectors that are null, or hold null or non-finite components, take no part,
nor do null ids. Fewer than k candidates: all are returned. Ties go to the smaller id.
Rows that repeat an id are separate candidates, and never candidates of their own id.
Vectors of several lengths are compared within their length only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import parallelism

BLOCK = 512  # vectors a block
SHARD = 65_536  # candidate rows a shard, at most about
SLICE = 32_768  # queries a slice, about: every slice reads all candidates once


def integer_vectors(df: DataFrame, vector: str = "embedding", ident: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(id, v): ids with whole finite vectors, as floor(scale * component)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = df.where(F.col(vector).isNotNull() & F.col(ident).isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return clean.select(F.col(ident).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.float64)  # whole numbers: exact below 2**53


def _merge(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -score))[:k]
    return score[keep], ids[keep]


def pruned_search(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, block: int = BLOCK) -> tuple[list, dict]:
    """[(query id, id, score)] of one slice against one shard, and how many blocks were scored."""
    order = np.argsort(d_ids, kind="stable")
    d_ids, d = d_ids[order], d[order]
    edges = list(range(0, len(d_ids), block))
    high = np.stack([d[e : e + block].max(axis=0) for e in edges])
    low = np.stack([d[e : e + block].min(axis=0) for e in edges])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T  # queries x blocks
    turn = np.argsort(-bounds, axis=1, kind="stable")
    best_s = [np.zeros(0)] * len(q)
    best_i = [np.zeros(0, np.int64)] * len(q)
    kth = np.full(len(q), -np.inf)
    alive = np.arange(len(q))
    scored = 0
    for step in range(len(edges)):
        alive = alive[bounds[alive, turn[alive, step]] >= kth[alive]]
        if not len(alive):
            break
        for b in np.unique(turn[alive, step]):
            mine = alive[turn[alive, step] == b]
            rows = slice(edges[b], edges[b] + block)
            scores = q[mine] @ d[rows].T
            scored += len(mine)
            for at, row in zip(mine, scores, strict=True):
                hit = np.flatnonzero((row >= kth[at]) & (d_ids[rows] != q_ids[at]))
                if len(hit):
                    best_s[at], best_i[at] = _merge(np.concatenate([best_s[at], row[hit]]), np.concatenate([best_i[at], d_ids[rows][hit]]), k)
                    if len(best_s[at]) == k:
                        kth[at] = best_s[at][-1]
    out = [(int(q_ids[i]), int(x), int(s)) for i in range(len(q)) for x, s in zip(best_i[i], best_s[i], strict=True)]
    return out, {"scored": scored, "of": len(q) * len(edges)}


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for every row of (id, v) that ``is_query`` marks."""
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    width = parallelism(vectors.sparkSession)
    shards, slices = max(1, -(-n // SHARD), min(width, -(-n // (8 * BLOCK)))), max(1, -(-n_queries // SLICE))
    sized = vectors.withColumn("dim", F.size("v"))
    grid = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Ranges of ids that a shard's blocks cover; the same grid cell for queries and blocks.
    shard = F.pmod(F.floor(F.col("id") / BLOCK), F.lit(shards)).cast("int").alias("shard")
    part = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice")
    docs = sized.select("id", "v", "dim", shard).select("*", grid(slices).alias("slice"))
    queries = sized.where(is_query).select("id", "v", "dim", part).select("*", grid(shards).alias("shard"))

    def search(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(qs) and len(ds):
            found, _ = pruned_search(qs["id"].to_numpy(), _matrix(qs.v), ds["id"].to_numpy(), _matrix(ds.v), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ["dim", "slice", "shard"]
    best = queries.groupBy(*keys).cogroup(docs.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    ranked = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score")
    )
