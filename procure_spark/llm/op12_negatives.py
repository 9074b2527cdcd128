"""Hard-negative mining with anchor-clustered shared lists.

Vectors become integers, floor(256 x). Anchors are clustered by direction. For a cluster with centre c whose members
stand at angles of at most theta from c, a candidate v at the angle phi has with every member a an inner product of at most
``|a| |v| cos(max(0, phi - theta))``. A block's candidates are sorted by that bound once for the cluster, and all members
walk the one list, a step at a time, with exact products; a member leaves once the bound of what is ahead is
below what it still needs (certified termination). What it needs is its k-th best score so far, at least the
lower end of the scores that may be returned.

1. Positives: of each anchor the best rows of its own label. Blocks are packed in the order of labels, so that
   an anchor block meets those candidate blocks only that its labels may stand in.
2. Negatives: for each positive the best rows of other labels whose score lies in a band of the positive's. Every
   anchor block meets every candidate block (a stated query set against all rows). All of an anchor's positives are
   served by one walk: it goes on until each of them has its negatives or the list is below each one's band.

A unit of work is an anchor block and a run of candidate blocks, which are gone through one at a time with the
best rows so far, so that a unit gives k rows for an anchor and positive at most. Where the labels, clusters and ids of a
third of all rows are the same, blocks are as small as elsewhere, since rows are dealt by range and then by id.

Centres are fitted on at most ``SAMPLE`` anchors (the least by a hash); they decide which anchors share a list, and change
no result. How much the bounds drop depends on the vectors (README).

Defined cases: rows with a null id or label, and vectors that are null, empty, or hold null or non-finite components take
no part; vectors of another length than an anchor's are no candidates of it; rows of the anchor's own id are
none either; repeated rows are candidates each for itself, and repeated anchors (of equal id, label and vector)
count once; anchors of one id that differ are mined each for itself; ties go to the smaller id; products of any size
are exact, and a score in a result that no long holds is an error; anchors without positives, and positives without
negatives, have no rows; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procure_spark.llm.common import table, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 10

#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 30, 90

#: Anchors and candidates in a block; candidates between looks at the bounds; candidate blocks in a run.
ANCHORS, BLOCK, STEP, RUN = 1024, 4096, 256, 32

#: Anchors that the centres are fitted on at most; centres.
SAMPLE, CENTRES = 4096, 16

NONE = -(2**62)


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v): usable rows, vectors as arrays of doubles."""
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) > 0) & fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))


def whole(vectors: list) -> tuple[str, bytes]:
    """floor(SCALE x) in the smallest type that holds it."""
    v = np.floor(SCALE * np.array(vectors, float))
    most = np.abs(v).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, v.astype(kind).tobytes()


def packed(rows: DataFrame, block: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, v, extra) -> blocks of up to ``block`` vectors of one length, next to each other in label and extra."""
    names = ("id", "label", *extra)
    dealt = rows.withColumn("dim", F.size("v")).repartitionByRange("dim", "label", *extra, F.xxhash64("id"))
    dealt = dealt.sortWithinPartitions("dim", "label", *extra).select("dim", *names, "v")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(own: list[tuple]) -> pd.DataFrame:
            cols = list(zip(*own, strict=True))
            kind, vectors = whole(cols[-1])
            row = {"dim": own[0][0], "kind": kind, "vectors": vectors, "low_label": min(cols[2]), "high_label": max(cols[2])}
            return pd.DataFrame([row | {n: np.array(c, "<i8").tobytes() for n, c in zip(names, cols[1:-1], strict=True)}])

        held: list[tuple] = []
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                if held and (r[0] != held[0][0] or len(held) == block):
                    yield one(held)
                    held = []
                held.append(r)
        if held:
            yield one(held)

    return dealt.mapInPandas(pack, f"dim int, kind string, vectors binary, low_label long, high_label long, {', '.join(f'{n} binary' for n in names)}")


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector stays zero."""
    norms = np.linalg.norm(v, axis=1)
    return v / np.where(norms > 0, norms, 1)[:, None], norms


def fitted_centres(anchors: DataFrame, sample: int = SAMPLE, centres: int = CENTRES) -> np.ndarray:
    """Centres of directions by a few rounds of spherical k-means over at most ``sample`` anchors of the commonest length."""
    dim = anchors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dim is None:
        return np.zeros((0, 0))
    rows = anchors.filter(F.size("v") == dim["n"]).orderBy(F.xxhash64("id", "label"), "id", "v").limit(sample).collect()
    units, _ = directions(np.array([r["v"] for r in rows], float))
    found = units[:: max(1, len(units) // centres)][:centres]
    for _ in range(8):
        of = (units @ found.T).argmax(1)
        found = directions(np.stack([units[of == i].sum(0) if (of == i).any() else c for i, c in enumerate(found)]))[0]
    return found


def clustered(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """anchors with the centre that each is nearest to; those of another length have none and are one cluster."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = [int((centres @ np.asarray(v, float)).argmax()) if centres.shape[1:] == (len(v),) else -1 for v in b["v"]]
            yield b.assign(cluster=of)

    return anchors.mapInPandas(nearest, "id long, label long, v array<double>, cluster int") if len(centres) else anchors.withColumn("cluster", F.lit(-1))


def products(anchors: np.ndarray, vectors: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers; most: a bound of their size."""
    if most < 2**49:  # so are doubles
        return np.rint(anchors @ vectors.T).astype(np.int64)
    if most < 2**62:
        return anchors.astype(np.int64) @ vectors.T.astype(np.int64)
    exact = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (anchors, vectors))
    scores = next(exact) @ next(exact).T
    if (np.abs(scores) >= -NONE).any():
        raise OverflowError("a score is beyond the range of long")
    return scores.astype(np.int64)


def walk(anchors: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, able, ids: np.ndarray, score: np.ndarray, of: np.ndarray, told: dict | None = None) -> None:
    """Takes candidates whose score lies in an anchor's band into ``score`` and ``of``, the (anchors, bands, k) best
    scores and their ids. able(members, candidates) says which pairs may be taken. told: counts products."""
    units, norms = directions(anchors)
    centre = directions(units.sum(0, keepdims=True))[0][0]
    cand, sizes = directions(vectors)
    theta = np.arccos(np.clip(units @ centre, -1, 1)).max()
    bound = sizes * np.cos(np.maximum(0, np.arccos(np.clip(cand @ centre, -1, 1)) - theta - 1e-7))
    order = np.argsort(-bound, kind="stable")
    most = float(norms.max(initial=0) * sizes.max(initial=0))
    alive = np.arange(len(anchors))
    for at in range(0, len(ids), STEP):
        part = order[at : at + STEP]
        # What each band still needs: its k-th best score, at least its lower end. The slack is far above rounding.
        needed = np.maximum(low[alive], score[alive, :, -1]).min(axis=1)
        ahead = norms[alive] * (bound[part[0]] + 1e-6 * sizes.max()) + 1e-3
        alive = alive[(ahead >= needed) & (needed < -NONE)]
        if not len(alive):
            break
        scores = products(anchors[alive], vectors[part], most)
        if told is not None:
            told["products"] = told.get("products", 0) + scores.size
        may = able(alive, part)
        for band in range(low.shape[1]):
            worst = score[alive, band, -1, None]
            fit = may & (scores >= low[alive, band, None]) & (scores <= high[alive, band, None])
            fit &= (scores > worst) | ((scores == worst) & (ids[part] < of[alive, band, -1, None]))
            rows = np.flatnonzero(fit.any(1))
            if not len(rows):
                continue
            who = alive[rows]
            values = np.concatenate([score[who, band], np.where(fit[rows], scores[rows], NONE)], axis=1)
            names = np.concatenate([of[who, band], np.broadcast_to(ids[part], (len(rows), len(part)))], axis=1)
            first = np.lexsort((names, -values), axis=1)[:, : score.shape[2]]
            score[who, band], of[who, band] = np.take_along_axis(values, first, 1), np.take_along_axis(names, first, 1)


def meetings(left: DataFrame, right: DataFrame, name: str, overlap: bool) -> tuple[DataFrame, DataFrame]:
    """Anchor blocks with the candidate blocks that they meet, by units; the anchor blocks, written and numbered."""
    left = written(left if "ab" in left.columns else left.withColumn("ab", F.monotonically_increasing_id()), f"{name}-anchors")
    n = right.count()
    right = right.select("dim", *[F.col(c).alias(f"c_{c}") for c in ("kind", "vectors", "id", "label", "low_label", "high_label")], "cb", F.pmod(F.xxhash64("cb"), F.lit(-(-n // RUN) or 1)).alias("run"))
    here = F.col("c_low_label").between(F.col("low_label"), F.col("high_label")) | F.col("low_label").between(F.col("c_low_label"), F.col("c_high_label"))
    other = ~((F.col("low_label") == F.col("high_label")) & (F.col("c_low_label") == F.col("low_label")) & (F.col("c_high_label") == F.col("low_label")))
    # Fragment and replicate by numbers alone; a candidate block goes once to every anchor block that it meets.
    ranges = left.groupBy("dim").agg(F.collect_list(F.struct("ab", "low_label", "high_label")).alias("__to"))
    to = right.join(ranges, "dim").withColumn("__to", F.explode("__to")).select(*right.columns, "__to.*").filter(here if overlap else other)
    pairs = to.drop("low_label", "high_label", "dim").join(left, "ab")
    return pairs.withColumn("unit", F.xxhash64("ab", "run")).repartition("unit").sortWithinPartitions("unit", "ab", "run", "cb"), left


def mined(pairs: DataFrame, bands: int, k: int, same: bool) -> DataFrame:
    """Meetings -> (ab, row, band, anchor_id, id, score): each unit's best candidates of each anchor (by its row in the block) and band.
    same: candidates of the anchor's own label, without a band; else those of others, in the bands of ``best``."""
    columns = ["ab", "run", "kind", "vectors", "id", "label", "cluster", *([] if same else ["best"]), "dim", "c_kind", "c_vectors", "c_id", "c_label"]

    def opened(r) -> dict:
        m = len(r.id) // 8
        low, high = np.full((m, bands), NONE), np.full((m, bands), -NONE)
        if not same:
            low, high = -low, -high  # bands that an anchor hasn't are empty and need nothing
            for i, own in enumerate(r.best):
                for j, score in enumerate(own):
                    a, z = -(-LOW * int(score) // 100), HIGH * int(score) // 100
                    if a <= z:
                        low[i, j], high[i, j] = a, z
        return {"low": low, "high": high, "score": np.full((m, bands, k), NONE), "of": np.full((m, bands, k), -NONE), "ids": np.frombuffer(r.id, "<i8")}

    def met(r, s: dict) -> None:
        unpacked = lambda data, kind: np.frombuffer(data, kind).reshape(-1, r.dim).astype(float)
        anchors, vectors = unpacked(r.vectors, r.kind), unpacked(r.c_vectors, r.c_kind)
        a_ids, a_labels, clusters, ids, labels = (np.frombuffer(x, "<i8") for x in (r.id, r.label, r.cluster, r.c_id, r.c_label))
        for cluster in np.unique(clusters):
            own = np.flatnonzero(clusters == cluster)
            able = lambda members, cand, own=own: ((labels[cand] == a_labels[own[members], None]) == same) & (ids[cand] != a_ids[own[members], None])
            score, of = s["score"][own], s["of"][own]
            walk(anchors[own], vectors, s["low"][own], s["high"][own], able, ids, score, of)
            s["score"][own], s["of"][own] = score, of

    def found(unit: tuple[int, int], s: dict) -> pd.DataFrame:
        row, band, place = np.nonzero(s["score"] > NONE)
        return pd.DataFrame({"ab": unit[0], "row": row, "band": band, "anchor_id": s["ids"][row], "id": s["of"][row, band, place], "score": s["score"][row, band, place]})

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, state = None, {}
        for b in batches:
            for r in b.itertuples(index=False):
                if (r.ab, r.run) != unit:
                    if unit:
                        yield found(unit, state)
                    unit, state = (r.ab, r.run), opened(r)
                met(r, state)
        if unit:
            yield found(unit, state)

    return pairs.select(*columns).mapInPandas(mine, "ab long, row int, band int, anchor_id long, id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """found with its rank by anchor and band, k at most."""
    order = Window.partitionBy("ab", "row", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """(id, label, v) twice -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    right = written(packed(rows, block).withColumn("cb", F.monotonically_increasing_id()), "op12-candidates")
    anchors = written(anchors.dropDuplicates(), "op12-rows")
    anchors = clustered(anchors, fitted_centres(anchors))
    pairs, left = meetings(packed(anchors, anchor_block, ("cluster",)), right, "op12-positives", True)
    near = best_of(mined(pairs, 1, positives, True), positives).select("ab", "row", F.col("rank").alias("band"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = written(near, "op12-positives")
    # The same blocks with the scores of each anchor's positives, in the order of its bands.
    own = near.groupBy("ab", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "positive_score"))), lambda x: x["positive_score"]).alias("own"))
    lists = own.groupBy("ab").agg(F.map_from_entries(F.collect_list(F.struct("row", "own"))).alias("__own"))  # a block's rows
    count = (F.octet_length("id") / 8).cast("int")
    best = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.coalesce(F.try_element_at("__own", i), F.array().cast("array<long>")))
    second, _ = meetings(left.join(lists, "ab").withColumn("best", best).drop("__own"), right, "op12-negatives", False)
    far = best_of(mined(second, positives, negatives, False), negatives).withColumn("band", F.col("band") + 1)
    far = far.select("ab", "row", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["ab", "row", "band"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.filter(F.col("id") % 100 == 0))


SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT min(r) AS a, vec_id, label, v FROM whole WHERE vec_id % 100 = 0 GROUP BY vec_id, label, v),
scored AS (
  SELECT a, q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM anchors q JOIN whole c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
positives AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS band FROM scored WHERE same QUALIFY band <= 5),
negatives AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY a, band ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN (SELECT a, vec_id, score FROM scored WHERE NOT same) n USING (a) WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM negatives WHERE rank <= 10
"""
