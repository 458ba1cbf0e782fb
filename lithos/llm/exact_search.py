"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments, coarse to fine. The means and deviations of two vectors' segments bound their distance from
below, d^2 >= sum of width * ((mean - mean')^2 + (deviation - deviation')^2), and so their inner product
(|q|^2 + |v|^2 - d^2) / 2 from above. Candidates that some level rules out against a query's k-th best score so far are
dropped; the survivors of the finest level get exact scores. Queries and candidates meet in blocks of bounded size. A first
block of candidates gives each query a k-th best score to begin with, so that the others return what may still be better.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import Scratch, for_python

SCALE, K = 1024, 10
#: Segments of each level, and rows of a block of candidates and of queries.
LEVELS, CANDIDATES, QUERIES = (1, 4, 16), 2048, 4096
#: Pairs whose components are gathered at once.
AT_ONCE = 1 << 15


def usable(vec: Column) -> Column:
    """Vectors that are not null and hold finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vec, bad), F.lit(False))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of their widths."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts, cuts[1:])]
    root = [np.sqrt(p.shape[1]) for p in parts]
    return np.stack([p.mean(axis=1) * r for p, r in zip(parts, root)] + [p.std(axis=1) * r for p, r in zip(parts, root)], axis=1)


def block_best(query_ids, queries: np.ndarray, ids, vectors: np.ndarray, id_order: np.ndarray, k: int, known: np.ndarray | None = None):
    """(query row, candidate row, score) of each query's k best of this block; ties to the first in `id_order`. What lies below
    the score `known` of a query is left out."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    if exact >= 2.0**63:
        raise ArithmeticError("scores don't fit 64 bits")
    whole = np.int64 if exact >= 2.0**53 else np.float64
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    levels = [(statistics(q, n), statistics(v, n)) for n in LEVELS if n <= v.shape[1]]
    place = np.empty(len(ids), dtype=np.int64)
    place[id_order] = np.arange(len(ids))
    slack = 1e-9 * (1 + np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1)).max(initial=0))
    wq, wv = queries.astype(whole), vectors.astype(whole)
    known = np.full(len(q), -np.inf) if known is None else known
    seed = 0 if np.isfinite(known).all() else min(len(ids), 16 * k)
    out_q, out_v, out_s = [], [], []
    start = (wq @ wv[:seed].T).astype(np.float64)
    start[query_ids[:, None] == ids[None, :seed]] = -np.inf
    floor = np.partition(start, max(0, seed - k), axis=1)[:, max(0, seed - k)] if seed >= k else np.full(len(q), -np.inf)
    floor = np.maximum(floor, known)
    for lo in range(0, len(ids), 512):
        hi = min(lo + 512, len(ids))
        a = b = None
        for sq, sv in levels:
            if a is None:
                a, b = np.nonzero(sq @ sv[lo:hi].T + slack >= floor[:, None])
                b += lo
            else:
                keep = [np.einsum("ij,ij->i", sq[a[i : i + AT_ONCE]], sv[b[i : i + AT_ONCE]]) + slack[a[i : i + AT_ONCE], 0] >= floor[a[i : i + AT_ONCE]] for i in range(0, len(a), AT_ONCE)]
                keep = np.concatenate([np.zeros(0, bool), *keep])
                a, b = a[keep], b[keep]
        if a is None:
            a, b = (x.ravel() for x in np.meshgrid(np.arange(len(q)), np.arange(lo, hi), indexing="ij"))
        s = np.concatenate([np.zeros(0, whole), *(np.einsum("ij,ij->i", wq[a[i : i + AT_ONCE]], wv[b[i : i + AT_ONCE]]) for i in range(0, len(a), AT_ONCE))]).astype(np.int64)
        own = query_ids[a] != ids[b]
        out_q, out_v, out_s = [np.concatenate([*x, y[own]]) for x, y in zip(((out_q,), (out_v,), (out_s,)), (a, b, s))]
        order = np.lexsort((place[out_v.astype(np.int64)], -out_s, out_q))
        out_q, out_v, out_s = (x[order] for x in (out_q, out_v, out_s))
        rank = np.arange(len(out_q)) - np.searchsorted(out_q, out_q, side="left")
        kth = rank == k - 1
        floor[out_q[kth].astype(np.int64)] = np.maximum(floor[out_q[kth].astype(np.int64)], out_s[kth])
        out_q, out_v, out_s = (x[rank < k] for x in (out_q, out_v, out_s))
    return out_q.astype(np.int64), out_v.astype(np.int64), out_s.astype(np.int64)


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` with `is_query`, the k other rows with the highest inner
    product of floor(scale * component), ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, neither do queries without an id; a
    candidate's null id is larger than any. Vectors of different lengths are not compared. Rows with one id are one
    query (the least vector) but several candidates; none of them is its own candidate. A query without candidates has
    no rows; an empty table gives an empty result. A score beyond 64 bits is an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    for_python(spark, CANDIDATES)
    scratch = Scratch(spark, "search")
    whole = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(vec_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))
    asked = scratch.save(rows.where("q AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("m")).select("id", "m.dim", "m.v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n")).first().n, asked.count()
    chunks, blocks = (max(1, -(-n // most)) for n, most in zip(sizes, (CANDIDATES, QUERIES)))
    # each candidate meets each block of queries once, each query each block of candidates
    chunk = F.pmod(F.xxhash64("id", "v"), F.lit(chunks))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = rows.select("dim", chunk.alias("chunk"), spread(blocks).alias("block"), "id", "v")

    def meeting(queries: DataFrame, first: int, last: int) -> DataFrame:
        """What the blocks of candidates from `first` to `last` find."""
        right = queries.select("dim", F.explode(F.sequence(F.lit(first), F.lit(last)).cast("array<long>")).alias("chunk"), block.alias("block"), "id", "v", "known")
        key = ["dim", "chunk", "block"]
        some = left.where(F.col("chunk").between(first, last))
        return some.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")

    def search(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not candidates.num_rows or not queries.num_rows:
            return empty
        dim = key[0].as_py()
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
        ids = candidates.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        none = min([i for i in ids if i is not None], default=0)
        names = np.array([i if i is not None else none for i in ids], dtype=np.int64)
        asked_ids = queries.column("id").to_numpy()
        if None in ids:  # no query has a null id: these take the place of an id that isn't asked here
            free = next(x for x in range(len(asked_ids) + 1) if x not in set(asked_ids.tolist()))
            names[[i for i, x in enumerate(ids) if x is None]] = free
        known = queries.column("known").to_numpy()
        a, b, s = block_best(asked_ids, matrix(queries), names, matrix(candidates), np.array(order), k, np.where(np.isnan(known), -np.inf, known))
        return pa.table({"query_id": pa.array(asked_ids[a]), "vec_id": pa.array([ids[i] for i in b], pa.int64()), "score": pa.array(s)})

    found = meeting(asked.withColumn("known", F.lit(None).cast("double")), 0, 0)
    if chunks > 1:
        found = scratch.save(found)
        floors = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floors = floors.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).cast("double").alias("known"))
        found = found.union(meeting(scratch.save(asked.join(floors, "id", "left")), 1, chunks - 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
