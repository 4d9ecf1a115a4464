"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integers, ``floor(256 * x)``. Candidates are dealt into shards by a hash of
the id and the row's place (so neither a range of ids nor one repeated id can crowd one task;
the result does not depend on where a row goes), and inside a shard cut into blocks of consecutive
ids; each block keeps, for every dimension, its
largest and smallest component. For a query q the score of any vector v in a block is at most
``sum(max(q_d * max_d, q_d * min_d))``: the block's bound. A query visits the blocks of a shard
in descending bound and scores each through the block's forward index (its matrix of vectors)
until the next bound is below its k-th best score so far; what is left cannot enter the top k,
ties included (ties go to the smaller id, so a block whose bound equals the k-th score is still
read). Each (shard, query block) pair is one task, so queries and candidates are both split;
per query at most k rows a shard come back, and the final cut is a window over those.

Edges: rows whose vector is null or holds a null, NaN or infinite component take no part, nor do
rows with a null id. Vectors of unequal length are multiplied over their common length. Equal
ids: every row but those with the query's own id is a candidate, so repeated rows appear as
repeated results. An empty table gives an empty result. Extra input columns are not read.
Scores are exact while ``d * max|floor(256 x)|^2 < 2^63``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in one block of consecutive ids; rows of a shard; queries in one query block.
BLOCK_ROWS = 256
SHARD_ROWS = 32768
QUERY_ROWS = 4096

RESULT = "query_id long, rank int, vec_id long, score long"
_PARTIAL = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, w): valid rows only, each component as ``floor(256 * x)``."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("bigint")).alias("w"),
    )


def _matrix(column: pd.Series) -> np.ndarray:
    width = max((len(v) for v in column), default=0)
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _search(k: int, block_rows: int):
    def run(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if cands.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        cands = cands.sort_values("vec_id", kind="stable")
        ids = cands["vec_id"].to_numpy(np.int64)
        C, Q = _matrix(cands["w"]), _matrix(queries["w"])
        d = max(C.shape[1], Q.shape[1])
        C = np.pad(C, ((0, 0), (0, d - C.shape[1])))
        Q = np.pad(Q, ((0, 0), (0, d - Q.shape[1])))
        # Floating products are exact below 2^53; beyond that integers (slower, same result).
        big = float(max(np.abs(C).max(initial=0), 1)) * float(max(np.abs(Q).max(initial=0), 1)) * max(d, 1)
        kind = np.float64 if big < 2.0**53 else np.int64
        Cf, Qf = C.astype(kind), Q.astype(kind)
        starts = np.arange(0, len(ids), block_rows)
        top = np.maximum.reduceat(C, starts, axis=0).astype(kind)
        low = np.minimum.reduceat(C, starts, axis=0).astype(kind)
        bounds = np.maximum(Qf, 0) @ top.T + np.minimum(Qf, 0) @ low.T
        out_q, out_v, out_s = [], [], []
        for qi, qid in enumerate(queries["vec_id"].to_numpy(np.int64)):
            best_s = np.empty(0, dtype=np.int64)
            best_v = np.empty(0, dtype=np.int64)
            for b in np.argsort(-bounds[qi], kind="stable"):
                if len(best_s) == k and bounds[qi, b] < best_s[-1]:
                    break
                lo, hi = starts[b], min(starts[b] + block_rows, len(ids))
                s = (Cf[lo:hi] @ Qf[qi]).astype(np.int64)
                v = ids[lo:hi]
                keep = v != qid
                s = np.concatenate([best_s, s[keep]])
                v = np.concatenate([best_v, v[keep]])
                order = np.lexsort((v, -s))[:k]
                best_s, best_v = s[order], v[order]
            out_q.append(np.full(len(best_s), qid, dtype=np.int64))
            out_v.append(best_v)
            out_s.append(best_s)
        return pd.DataFrame(
            {"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)}
        )

    return run


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query's k highest inner products over all other rows, exact; ``RESULT`` columns.

    ``vectors``: (vec_id, w) from ``integer_vectors``. ``is_query``: a condition on those columns.
    Shard and query-block counts follow the row counts, so a task's memory stays bounded.
    """
    vectors = vectors.select("vec_id", "w")
    queries = vectors.where(is_query)
    n_cands, n_queries = vectors.count(), queries.count()
    n_shards = max(1, math.ceil(n_cands / shard_rows))
    n_qblocks = max(1, math.ceil(n_queries / query_rows))
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_shards)).cast("int")
    cands = vectors.select("vec_id", "w", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_qblocks - 1))).alias("qblock"))
    asked = queries.select(
        "vec_id",
        "w",
        F.pmod(F.xxhash64("vec_id"), F.lit(n_qblocks)).cast("int").alias("qblock"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
    )
    keys = ["shard", "qblock"]
    partial = (
        cands.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(lambda c, q: _search(k, block_rows)(c[["vec_id", "w"]], q[["vec_id", "w"]]), _PARTIAL)
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
