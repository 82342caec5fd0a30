"""Exact top-k inner products with block-at-a-time pruning.

Vectors become integer terms (one for each component).  Candidates are sorted
by their strongest component and cut into blocks; a block keeps the largest
and the smallest value of each term and, as its forward index, the matrix of
its rows.  For a query, blocks are visited in the order of their bounds (the
sum over terms of the query's weight times the extreme that helps it), scored
through the forward index, and the visit ends when the bound is below the
k-th best score so far.

Candidates are dealt over shards and queries over groups, both of bounded
size; each (shard, group) is one task's work and gives k rows for a query,
which a window over the shards reduces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, EACH = 256, 50
#: Vectors in a block, candidates in a shard, queries in a group.
BLOCK, SHARD, GROUP = 64, 8192, 2048


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (floor of SCALE times each component); vectors that are null, empty or hold null or non-finite components are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(key).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    return rows.where(finite).select("id", F.transform("x", lambda c: F.floor(c * float(SCALE)).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    width = max(map(len, rows))
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Blocks:
    """Candidates of one shard in blocks."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        strongest = np.argmax(np.abs(rows), axis=1)
        order = np.lexsort((ids, rows[np.arange(len(rows)), strongest], strongest))
        self.ids, self.rows = ids[order], rows[order]
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high = np.maximum.reduceat(self.rows, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.rows, self.starts, axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def top(self, query_id: int, q: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        i = 0
        while i < len(order):
            # the first visit is one block, later ones take blocks together as long as their bounds reach the k-th
            some = order[i : i + (1 if i == 0 else 8)]
            if len(scores) >= k:
                some = some[bounds[some] >= scores[k - 1]]
                if not len(some):
                    break
            at = (self.starts[some][:, None] + np.arange(BLOCK)).ravel()
            at = at[at < len(self.ids)]
            at = at[self.ids[at] != query_id]
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, self.rows[at] @ q])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            i += 1 if i == 0 else 8
        return ids, scores


def top_k(vectors: DataFrame, k: int = 5, every: int = EACH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best other rows.

    Ties go to the smaller id.  A shorter vector lacks its missing terms (zero).
    Rows with the query's id are never its candidates; repeated candidates each
    take a rank.  No rows for a query without candidates.
    """
    held = integer_vectors(vectors, key, vector)
    n = held.agg(F.count("*").alias("n"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("q")).first()
    shards, groups = max(1, -(-n["n"] // SHARD)), max(1, -(-n["q"] // GROUP))
    candidates = held.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("shard", "part", "id", "v")
    queries = held.where(F.pmod("id", F.lit(every)) == 0).distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "part", "id", "v")

    def search(c: pa.Table, q: pa.Table) -> pa.Table:
        names, out = ["query_id", "vec_id", "score", "ordinal"], []
        if c.num_rows and q.num_rows:
            rows, wanted = _matrix(c.column("v")), _matrix(q.column("v"))
            width = max(rows.shape[1], wanted.shape[1])
            rows, wanted = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, wanted))
            blocks, ids = Blocks(c.column("id").to_numpy().astype(np.int64), rows), q.column("id").to_pylist()
            for i in range(0, len(ids), 256):
                bounds = blocks.bounds(wanted[i : i + 256])
                for query, v, b in zip(ids[i : i + 256], wanted[i : i + 256], bounds, strict=True):
                    found, scores = blocks.top(query, v, b, k)
                    out += [(query, int(d), int(s), j) for j, (d, s) in enumerate(zip(found, scores, strict=True))]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=names)

    found = candidates.groupBy("shard", "part").cogroup(queries.groupBy("shard", "part")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint, ordinal bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "ordinal")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
