"""Exact top-k by integer inner product: tiles of queries times shards of candidates, merged as a tree.

Queries are cut into tiles and candidates into shards of bounded size; every (tile, shard) pair is one group whose
score matrix is made by blocked matrix products, `block` candidates at a time, keeping only each query's best k of the
shard. The partial lists are merged `fan_in` shards at a time. A task holds one tile, one shard and one block of
scores, whatever the table's size; the stated query set meets all rows in blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE, SHARD, BLOCK, FAN_IN = 1024, 16_384, 4_096, 32
EXACT = 2.0**53


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; null for a null vector or one with a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")))


def best_of_block(scores, ids, k):
    """Rows of (row, id, score) with each row's k best: higher scores first, ties to the smaller id. ids ascend."""
    import numpy as np

    if scores.shape[1] > k:
        bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        bar = scores.min(axis=1)
    rows, cols, vals = [], [], []
    for i in range(scores.shape[0]):
        line = scores[i]
        over = np.flatnonzero(line >= bar[i])
        over = over[np.argsort(-line[over], kind="stable")][:k]
        rows.append(np.full(len(over), i))
        cols.append(ids[over])
        vals.append(line[over])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def _product(left, right):
    """left @ right.T in exact arithmetic: doubles where every partial sum stays below 2**53, else long integers."""
    import numpy as np

    top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if top < EXACT:
        return left.astype(np.float64) @ right.astype(np.float64).T
    return left @ right.T


def tile_scorer(k: int, block: int):
    def score(queries, candidates):
        """One tile against one shard, both Arrow tables (id, vector, ...): the tile's partial lists."""
        import numpy as np
        import pyarrow as pa

        def matrix(table):
            ids = table.column("id").to_numpy()
            flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks])
            order = np.argsort(ids, kind="stable")
            return ids[order], flat.reshape(table.num_rows, -1)[order]

        schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        shard = candidates.column("shard")[0].as_py()
        q_ids, q = matrix(queries)
        c_ids, c = matrix(candidates)
        parts = []
        for at in range(0, len(c_ids), block):
            ids = c_ids[at : at + block]
            scores = _product(q, c[at : at + block])
            own = q_ids[:, None] == ids[None, :]
            scores[own] = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
            rows, got, vals = best_of_block(scores, ids, k)
            keep = q_ids[rows] != got
            parts.append((rows[keep], got[keep], vals[keep]))
        rows, got, vals = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((got, -vals, rows))
        rows, got, vals = rows[order], got[order], vals[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, got, vals = (x[rank < k] for x in (rows, got, vals))
        return pa.table([q_ids[rows], np.full(len(rows), shard), got.astype("int64"), vals.astype("int64")], schema=schema)

    return score


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int, tile: int = TILE, shard: int = SHARD, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Each query's k candidates with the highest inner product: (query_id, rank, vec_id, score).

    Both frames: (id long, vector array<long>). A candidate with the query's own id is no candidate; other repeated
    rows each count. Null vectors take no part; only vectors of the same length meet. Ties go to the smaller id. Fewer
    than k candidates: all of them. Empty sides: no rows. Scores beyond a long wrap around.
    """
    queries = queries.where("vector is not null and id is not null").select("id", "vector", F.size("vector").alias("dim"))
    candidates = candidates.where("vector is not null and id is not null").select("id", "vector", F.size("vector").alias("dim"))
    n_tiles = max(1, math.ceil(queries.count() / tile))
    n_shards = max(1, math.ceil(candidates.count() / shard))
    spread = lambda df, own, n_own, other, n_other: (
        df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("bigint"))
        .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))))
    )
    left = spread(queries, "tile", n_tiles, "shard", n_shards)
    right = spread(candidates, "shard", n_shards, "tile", n_tiles)
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("dim", "tile", "shard", "id", "vector")])  # noqa: E731  both may come from one table
    keys = ["dim", "tile", "shard"]
    part = fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInArrow(tile_scorer(k, block), "query_id long, shard long, vec_id long, score long")
    groups = n_shards
    while True:
        groups = math.ceil(groups / fan_in)
        part = part.withColumn("shard", F.floor(F.col("shard") / fan_in))
        best = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), F.col("vec_id").asc())
        part = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if groups == 1:
            return part.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir):
    """The 10 best other vectors of every vector whose id is divisible by 100."""
    from .common import read_table

    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("vector"))
    return exact_topk(rows.where("id % 100 = 0"), rows, 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
