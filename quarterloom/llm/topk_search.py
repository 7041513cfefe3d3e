"""Exact top-k search over integer-quantised vectors.

Method: multi-resolution segment statistics. A vector is cut into 1, then 4,
then 16 segments; each segment keeps its sum / sqrt(length) and the norm of what
is left after removing its mean. With ``a`` and ``b`` those two numbers per segment,
``<x, y> <= sum(a_x a_y) + sum(b_x b_y)`` (Cauchy-Schwarz on the residuals), which is
the same statement as a lower bound on the Euclidean distance. Bounds are
evaluated coarse to fine; a level only sees the candidates that could still enter
the best k of some query of a tile, and survivors are scored exactly.

A first pass scores every query against a bounded sample of candidates. Its k-th best score is a
threshold from which all blocks start, so that none has to find its own.

Distribution: queries and candidates are dealt into blocks by hash of id and vector, every
block pair is one cogrouped task of bounded size, each task keeps k ids a query, and a
last aggregate ranks those. Repeated rows are folded first, before any shuffle. No side
is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEVELS = (1, 4, 16)
#: Queries of one tile, and candidates of the sample that gives the first thresholds.
TILE, SAMPLE = 64, 2048


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, x as double; null for unusable vectors."""
    ok = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(ok, F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def segment_stats(m: np.ndarray, segments: int) -> np.ndarray:
    """[sums / sqrt(length) | residual norms] of each row, per segment."""
    n, dim = m.shape
    edges = np.linspace(0, dim, min(segments, max(dim, 1)) + 1).astype(int)
    parts = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        seg = m[:, lo:hi]
        length = max(hi - lo, 1)
        total = seg.sum(axis=1) / math.sqrt(length)
        parts.append((total, np.sqrt(np.maximum((seg * seg).sum(axis=1) - total * total, 0.0))))
    return np.column_stack([p[0] for p in parts] + [p[1] for p in parts]) if parts else np.zeros((n, 2))


def _scores(q: np.ndarray, c: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products: in doubles while every partial sum is a whole number they can hold."""
    if top < 2**52:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def block_top_k(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score): the best k ids of one candidate block for each query row.

    ``q`` and ``c`` are int64 matrices. ``floor`` is a score that k other ids are known to reach
    (NaN if there is none): what is below it can be left out. An id's best vector counts;
    ties go to the smaller id.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]])) if len(cid) else np.zeros(0, int)
    cf = c.astype(np.float64)
    levels = [segment_stats(cf, s) for s in LEVELS]
    top = np.abs(cf).max(initial=0.0) * np.abs(q).astype(np.float64).max(initial=0.0) * max(c.shape[1], 1)
    slack = 1.0 + 1e-9 * top
    lowest = -np.iinfo(np.int64).max  # its negative is a number too
    for lo in range(0, len(q), TILE):
        qi, qb, least = qid[lo : lo + TILE], q[lo : lo + TILE], floor[lo : lo + TILE, None]
        qf = qb.astype(np.float64)
        at = np.arange(len(cid))
        for level, s in zip(levels, LEVELS, strict=True):
            bound = segment_stats(qf, s) @ level[at].T
            at = at[(np.isnan(least) | (bound + slack >= least)).any(axis=0)]
        if not len(at):
            continue
        score = _scores(qb, c[at], top)
        score[qi[:, None] == cid[at][None, :]] = lowest
        ids = cid[at]
        if len(first) < len(cid):  # an id with several vectors
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            score, ids = np.maximum.reduceat(score, starts, axis=1), ids[starts]
        score = np.where(np.isnan(least) | (score >= least), score, lowest)
        if len(ids) > k:
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero((score >= kth[:, None]) & (score > lowest))
        else:
            i, j = np.nonzero(score > lowest)
        best = np.lexsort((ids[j], -score[i, j], i))
        i, j = i[best], j[best]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[kept], j[kept]
        out.append((qi[i], ids[j], score[i, j]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pairs(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    as_matrix = lambda s: np.array(s.tolist(), dtype=np.int64).reshape(len(s), -1)
    a, b, s = block_top_k(left["query_id"].to_numpy(), as_matrix(left["v"]), left["floor"].to_numpy(dtype=float), right["vec_id"].to_numpy(), as_matrix(right["v"]), k)
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})


def _best(q: DataFrame, c: DataFrame, n_q: int, n_c: int, k: int) -> DataFrame:
    """``query_id, vec_id, score, rank``: the best k ids of every query among the candidates."""
    block = lambda seed, n: F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(n)).cast("int")
    q = q.select("query_id", "v", "dim", "floor", block(1, n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    c = c.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_c)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    keys = ["dim", "qb", "cb"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(lambda a, b: _pairs(a, b, k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, query_rows: int = 4096, candidate_rows: int = 4096) -> DataFrame:
    """The k best integer inner products of each query against all other rows.

    Queries are the rows whose id is divisible by ``every``. Returns ``query_id,
    rank, vec_id, score``; rank counts from 1, ties go to the smaller id.

    Defined cases: null, non-finite or partly null vectors and null ids take no
    part; vectors of different lengths are not compared; the same id and vector
    repeated counts once, however often; where an id has several vectors, its best score counts
    and no row with the query's own id answers it; fewer than k candidates give
    fewer rows; an empty table gives none. Scores must fit 64 bits. Other columns
    are ignored. ``query_rows`` and ``candidate_rows`` bound one task's block.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col)).alias("v")).where("vec_id is not null and v is not null")
    v = materialize(v.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")), "topk-vectors")
    n, nq = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    n_c, n_q = max(1, math.ceil(n / candidate_rows)), max(1, math.ceil(nq / query_rows))
    q = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "dim")
    none = F.lit(None).cast("double").alias("floor")
    if n <= 4 * SAMPLE:
        first = q.select("*", none)
    else:
        # a sample of the candidates, by hash: any k ids' scores bound the k-th best of all from below
        some = v.where(F.xxhash64("vec_id", F.lit(7)) < F.lit(-(2**63) + int(2**64 * SAMPLE / n)))
        floors = _best(q.select("*", none), some, n_q, 1, k).where(F.col("rank") == k).select(F.col("query_id").alias("f_id"), F.col("score").cast("double").alias("floor"))
        floors = materialize(floors, "topk-floors")
        first = q.join(floors, F.col("query_id") == F.col("f_id"), "left").drop("f_id")
    again = v.sparkSession.read.schema(v.schema).parquet(v._quarterloom_path)  # a lineage of its own
    return _best(first, again, n_q, n_c, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         max(CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  GROUP BY ALL
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
