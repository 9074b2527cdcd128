"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers, floor(256 x). A vector's segments at each resolution are described by their mean
and deviation. For two vectors, a segment of length n contributes to the squared distance at least
``n ((mean - mean')² + (dev - dev')²)``, so that their inner product is at most
``sum n (mean mean' + dev dev')``. Candidates whose bound lies under a query's threshold are dropped,
coarse resolutions first; products are computed exactly, in integers, of survivors alone.

Queries and candidates are packed into blocks of bounded size, in the smallest type that holds them. Each
query block first meets one block of candidates whole, which gives every query a threshold, its k-th best
score there; then every query block meets every candidate block (a stated query set against all rows),
and each meeting gives k rows a query at most. How much the bounds drop depends on the vectors: where
these have structure, nearly all; of directions spread evenly over the sphere, next to nothing before
segments of two dimensions (README).

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows with a null id; vectors of another length than most are compared with those of their own
length only; a query's own id is no candidate of it; repeated rows are candidates each for itself;
ties go to the smaller id; products of large components are computed in integers of any size, and a
score in a result that no long holds is an error; an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procure_spark.llm.common import table, written

K, SCALE, RESOLUTIONS = 5, 256, (1, 4, 16, 32)

#: Vectors in a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 4096, 16_384

#: Queries that are compared with a block at once, and candidates between looks at the k-th best.
QUERY_STEP, STEP = 256, 1024

#: Products are taken of survivors alone where these are under a share of a step's pairs; else a step's
#: matrix product costs less than picking them.
SPARSE = 0.05


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): usable vectors as arrays of doubles."""
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def packed(vectors: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(vectors).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, vectors.astype(kind).tobytes()


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """(dim, kind, ids, vectors): up to ``block`` vectors of one length, as packed whole numbers."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def one(dim: int) -> pd.DataFrame:
            own = held.pop(dim)
            kind, vectors = packed(np.floor(SCALE * np.array([v for _, v in own], float)))
            return pd.DataFrame([(dim, kind, np.array([i for i, _ in own], "<i8").tobytes(), vectors)], columns=["dim", "kind", "ids", "vectors"])

        for b in batches:
            for i, v in zip(b["id"], b["v"], strict=True):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == block:
                    yield one(len(v))
        for dim in list(held):
            yield one(dim)

    return rows.mapInPandas(pack, "dim int, kind string, ids binary, vectors binary")


def unpacked(dim: int, kind: str, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, kind).reshape(-1, dim).astype(float)


def segments(v: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of ``parts`` segments, each times the root of the segment's length."""
    means, devs = [], []
    for part in np.array_split(v.astype(float), min(parts, v.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        means.append(part.mean(axis=1) * root)
        devs.append(part.std(axis=1) * root)
    return np.stack(means, 1), np.stack(devs, 1)


def products(queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of pairs (row, column) of whole numbers."""
    if float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1] < 2**52:
        if len(rows) > SPARSE * len(queries) * len(vectors):
            return (queries @ vectors.T)[rows, cols].astype(np.int64)
        return np.einsum("ij,ij->i", queries[rows], vectors[cols]).astype(np.int64)
    whole = [[int(x) for x in v] for v in queries], [[int(x) for x in v] for v in vectors]
    return [sum(a * b for a, b in zip(whole[0][r], whole[1][c], strict=True)) for r, c in zip(rows.tolist(), cols.tolist(), strict=True)]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None, told: dict | None = None) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best among the candidates, as far as they reach its floor. told:
    counts pairs, and those that each resolution leaves."""
    out = []
    described = [np.hstack(segments(vectors, r)) for r in RESOLUTIONS]
    norms = np.linalg.norm(vectors, axis=1)
    for at in range(0, len(queries), QUERY_STEP):
        qs, qids = queries[at : at + QUERY_STEP], query_ids[at : at + QUERY_STEP]
        coarse, sizes = [np.hstack(segments(qs, r)) for r in RESOLUTIONS], np.linalg.norm(qs, axis=1)
        floor = np.full(len(qs), -np.inf) if floors is None else floors[at : at + QUERY_STEP].copy()
        found: list[list[tuple[int, int]]] = [[] for _ in qs]
        for c in range(0, len(vectors), STEP):
            part = slice(c, c + STEP)
            alive = ids[part][None, :] != qids[:, None]
            if told is not None:
                told["pairs"] = told.get("pairs", 0) + int(alive.sum())
            for n, q, v in zip(RESOLUTIONS, coarse, described, strict=True):
                rows, cols = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
                if not len(rows) or not len(cols):
                    break
                # Rounding is far under this slack; a bound that ties may hide a smaller id, so it stays.
                bound = q[rows] @ v[part][cols].T + 1e-9 * np.outer(sizes[rows], norms[part][cols]) + 1e-3
                alive[np.ix_(rows, cols)] &= bound >= floor[rows, None]
                if told is not None:
                    told[n] = told.get(n, 0) + int(alive.sum())
            rows, cols = np.nonzero(alive)
            if not len(rows):
                continue
            scores = products(qs, vectors[part], rows, cols)
            if isinstance(scores, np.ndarray):
                good = scores >= floor[rows]
                rows, cols, scores = rows[good], cols[good], scores[good].tolist()
            own_ids = ids[part][cols].tolist()
            ends = np.searchsorted(rows, np.arange(len(qs) + 1)).tolist()
            for r in np.unique(rows).tolist():
                own = range(ends[r], ends[r + 1])
                found[r] = sorted([*found[r], *((-scores[j], own_ids[j]) for j in own)])[:k]
                if len(found[r]) == k:
                    # As a double it may be above the score by rounding only where no double holds it.
                    floor[r] = max(floor[r], np.nextafter(float(-found[r][-1][0]), -np.inf) if abs(found[r][-1][0]) >= 2**53 else -found[r][-1][0])
        out += [(int(q), i, -s) for q, own in zip(qids, found, strict=True) for s, i in own]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k=K, block=BLOCK, query_block=QUERY_BLOCK) -> DataFrame:
    """(id, v) twice -> (query_id, rank, vec_id, score)."""
    left = written(blocks(queries, query_block).withColumn("qb", F.monotonically_increasing_id()), "op8-queries")
    right = written(blocks(candidates, block).withColumn("cb", F.monotonically_increasing_id()), "op8-candidates")
    right = right.withColumnsRenamed({"kind": "ckind", "ids": "cids", "vectors": "cvectors"})

    def thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qb, dim, kind, ids, vectors, ckind, cids, cvectors in b.itertuples(index=False):
                qi, qv = unpacked(dim, kind, ids, vectors)
                best: dict[int, list[int]] = {}
                for q, _, score in search(qi, qv, *unpacked(dim, ckind, cids, cvectors), k):
                    best.setdefault(q, []).append(score)
                floors = [np.nextafter(float(best[i][-1]), -np.inf) if len(best.get(i, ())) == k else -np.inf for i in qi.tolist()]
                yield pd.DataFrame([(qb, np.array(floors).tobytes())], columns=["qb", "floors"])

    # A query block's thresholds come from one block of candidates of its vectors' length.
    one = right.groupBy("dim").agg(F.min("cb").alias("cb"))
    near = left.join(right.join(one, ["dim", "cb"]), "dim").select("qb", "dim", "kind", "ids", "vectors", "ckind", "cids", "cvectors")
    floors = written(near.repartition("qb").mapInPandas(thresholds, "qb long, floors binary"), "op8-floors")
    # Fragment and replicate: a candidate block goes once to every query block of its vectors' length.
    to = left.groupBy("dim").agg(F.collect_list("qb").alias("qbs"))
    spread = right.join(to, "dim").withColumn("qb", F.explode("qbs")).drop("qbs", "dim")
    pairs = spread.join(left.join(floors, "qb"), "qb").select("dim", "kind", "ids", "vectors", "floors", "ckind", "cids", "cvectors", "qb", "cb")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, kind, ids, vectors, floors, ckind, cids, cvectors, _, _ in b.itertuples(index=False):
                found = search(*unpacked(dim, kind, ids, vectors), *unpacked(dim, ckind, cids, cvectors), k, np.frombuffer(floors))
                if any(abs(score) >= 2**63 for _, _, score in found):
                    raise OverflowError("a score is beyond the range of long")
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = pairs.repartition(F.xxhash64("qb", "cb")).mapInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return top_k(rows.filter(F.col("id") % 50 == 0), rows)


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
