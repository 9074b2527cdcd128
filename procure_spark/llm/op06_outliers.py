"""Quality rules with robust multivariate outliers.

Per language and source, the minimum covariance determinant of the documents' statistic vectors is
estimated by concentration steps: distances to the current centre and scatter, a share ``cover`` of the
rows that lie nearest, their mean and covariance, and again. There are three deterministic starts
(medians, with the correlations of nothing, of bounded and of spatial-sign scores); after ``TRIALS``
steps each group goes on with the start of the least determinant, until no determinant falls any more.
Every step runs over all rows of all groups at once: tasks measure rows with numpy and add them up per
group, and Spark adds up the tasks' sums, so that one group may hold any part of the rows.

A group's scatter and centre are regularised: ``prior`` rows of the fit of its language are mixed in, so
that a group of a few rows leans on its language and a large one on itself; no group is left out.

Documents far from their group's centre by Mahalanobis distance are rejected. Statistics are logarithms
and shares. The group's scatter decides; only counting sets a bound below: a count of about n varies by
the root of n (at least by one), and so a text of N characters, words or lines can't tell shares apart
that lie nearer than that (``least_variances``). The bound follows from a text's own size, and a group's
scatter is widened by that of its average size, so that neither constant statistics nor such as always
agree make a single count an outlier.

Defined cases: a null text is an empty one (no words, fails the base rule); a null language or source
is a group of its own; repeated rows count each; of equal distances at the edge of the nearest all count;
texts of any length are counted whole; an empty table gives an empty result; ``judge`` leaves out the text
and passes other columns through, except those named like its outputs, which it replaces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procure_spark.llm.common import table, written
from procure_spark.llm.text_stats import BASIC, basic_stats

COVER, TRIALS, STEPS, PRIOR, REJECT = 0.75, 2, 8, 10, 5e-5

#: A determinant's logarithm that falls by less has converged.
STILL = 1e-3

#: Words that a repeat counts at least: two windows of three.
REPEAT = 6


def vector(s: str) -> Column:
    """Transformed statistics: length, mean word length, symbols, repeated lines, repeated words,
    capitals, exclamation and question marks."""
    c = lambda name: F.col(f"{s}.{name}").cast("double")
    share = lambda a, b: F.log1p(100 * c(a) / F.greatest(c(b), F.lit(1.0)))
    return F.array(
        F.log1p(c("n_words")),
        c("word_chars") / F.greatest(c("n_words"), F.lit(1.0)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_upper", "word_chars"),
        share("n_marks", "word_chars"),
    )


def grains(s: str) -> Column:
    """What one count is of each statistic: a share of a word for the mean length, per cent for shares."""
    one = lambda name, n=1.0: F.lit(n) / F.greatest(F.col(f"{s}.{name}").cast("double"), F.lit(1.0))
    return F.array(F.lit(0.0), one("n_words"), one("word_chars", 100.0), one("n_lines", 100.0), one("n_words", 100.0 * REPEAT), one("word_chars", 100.0), one("word_chars", 100.0))


def least_variances(m: np.ndarray, grain: np.ndarray) -> np.ndarray:
    """Counting noise of the statistics of texts of these grains (a row each), in groups with centres m: that
    of a Poisson count, of one at least, carried through the logarithm. Statistics without a grain have none."""
    at = np.maximum(m, 0.0)
    out = np.maximum(grain * grain, grain * np.expm1(at)) * np.exp(-2 * at)
    out[:, 0], out[:, 1] = np.exp(-at[:, 0]), at[:, 1] * grain[:, 1]
    out[~grain.any(axis=1)] = 0.0
    return out


D = 7
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
I, J = (np.array(x) for x in zip(*PAIRS, strict=True))


def chi2_cdf(x: float, d: float) -> float:
    """Of the chi-squared distribution with d degrees of freedom, by the series of the gamma function."""
    if x <= 0:
        return 0.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    for k in range(1, 2000):
        term *= z / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, d: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, d) < p else (low, middle)
    return high


def distances(x: np.ndarray, grain: np.ndarray, m: np.ndarray, v: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Squared, of rows to their groups' fits. Where a text's counting noise exceeds the group's variance v,
    it takes its place; correlations stay."""
    diff = (x - m) * np.sqrt(v / np.maximum(v, least_variances(m, grain)))
    return np.maximum((inverse * np.where(I == J, 1.0, 2.0) * diff[:, I] * diff[:, J]).sum(axis=1), 0.0)


def matrix(batch: pa.RecordBatch, name: str, width: int = D) -> np.ndarray:
    """An array column without nulls as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


#: Of a group's rows: their number, sums, sums of products, sums of grains.
SUMS = 1 + D + len(PAIRS) + D


class Sums:
    """Sums of rows by (grp, start)."""

    def __init__(self):
        self.held: dict[tuple[str, str | None, int], np.ndarray] = {}

    def add(self, batch: pa.RecordBatch, start: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> None:
        if not batch.num_rows:
            return
        names, ups = batch.column("grp").dictionary_encode(), batch.column("up")
        key = names.indices.to_numpy() * 4 + start
        rows = np.hstack([np.ones((len(y), 1)), y, y[:, I] * y[:, J], matrix(batch, "g")])
        at = np.flatnonzero(mask) if mask is not None else np.arange(len(y))
        order = at[np.argsort(key[at], kind="stable")]
        if not len(order):
            return
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        for n, total in zip(first.tolist(), np.add.reduceat(rows[order], first), strict=True):
            row = int(order[n])
            held = names.dictionary[int(key[row]) // 4].as_py(), ups[row].as_py(), int(key[row]) % 4
            self.held[held] = self.held.get(held, 0.0) + total

    def batch(self) -> pa.RecordBatch:
        keys = list(self.held) or []
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32())]
        sums = np.array(list(self.held.values())).reshape(-1, SUMS)
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(sums[:, i]) for i in range(SUMS))], names=["grp", "up", "start", *(f"s{i}" for i in range(SUMS))])


def summed(rows: DataFrame, add: Callable[[Sums, pa.RecordBatch], None]) -> DataFrame:
    """(grp, up, start, s0..): what ``add`` adds up of the rows; a row per group of each task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            add(sums, b)
        yield sums.batch()

    parts = rows.mapInArrow(run, "grp string, up string, start int, " + ", ".join(f"s{i} double" for i in range(SUMS)))
    return parts.groupBy("grp", "up", "start").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(SUMS)])


FIT = "grp string, up string, start int, n long, m array<double>, v array<double>, i array<double>, det double"


def moments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and average grains of sums."""
    m, c = s[1 : D + 1] / s[0], np.zeros((D, D))
    c[I, J] = c[J, I] = s[D + 1 : D + 1 + len(PAIRS)] / s[0] - m[I] * m[J]
    return m, c, s[-D:] / s[0]


def inverted(m: np.ndarray, c: np.ndarray, grain: np.ndarray) -> tuple:
    """m, variances, inverse (as PAIRS) and the determinant's logarithm of a scatter, widened by counting noise."""
    c = c if np.isfinite(c).all() else np.zeros((D, D))
    c = c + np.diag(least_variances(m[None], grain[None])[0] + np.diag(c) * 1e-6 + 1e-9)
    deviations = np.sqrt(np.diag(c))
    shape = c / np.outer(deviations, deviations)
    inverse = np.linalg.inv(shape) / np.outer(deviations, deviations)
    return m, np.diag(c), inverse[I, J], float(np.linalg.slogdet(shape)[1] + 2 * np.log(deviations).sum())


def invert(sums: DataFrame, scale: float, prior: float) -> DataFrame:
    """Fits of sums: each scatter, times scale, and centre are mixed with ``prior`` rows of those of the group above."""

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                n = r["s0"]
                m, c, grain = moments(np.array([r[f"s{i}"] for i in range(SUMS)]))
                if r["t0"] is not None and r["t0"] > 0:
                    tm, tc, _ = moments(np.array([r[f"t{i}"] for i in range(SUMS)]))
                    w = n / (n + prior)
                    m, c = w * m + (1 - w) * tm, w * c + (1 - w) * tc
                rows.append((r["grp"], r["up"], r["start"], int(n), *inverted(m, c * scale, grain)))
            yield pd.DataFrame(rows, columns=["grp", "up", "start", "n", "m", "v", "i", "det"])

    above = sums.filter("up is null").select(F.col("grp").alias("__up"), F.col("start").alias("__start"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SUMS)])
    both = sums.join(above, (F.col("up") == F.col("__up")) & (F.col("start") == F.col("__start")), "left").drop("__up", "__start")
    return both.mapInPandas(fits, FIT)


def measured(rows: DataFrame, fits: DataFrame, *more: str) -> DataFrame:
    """rows with their groups' fits. A fit is a row of a written table: Spark knows its size, broadcasts it where
    it is small, and sorts both sides where it isn't."""
    return rows.join(fits.select("grp", "start", "m", "v", "i", *more), "grp")


def to_fits(b: pa.RecordBatch) -> np.ndarray:
    return distances(matrix(b, "x"), matrix(b, "g"), matrix(b, "m"), matrix(b, "v"), matrix(b, "i", len(PAIRS)))


def with_distance(rows: DataFrame, kept: list[str]) -> DataFrame:
    """kept columns of rows with fits, and d2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(to_fits(b))], names=[*kept, "d2"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("d2", T.DoubleType())]))


def starts(rows: DataFrame) -> DataFrame:
    """Three fits of each group: medians as centres; quartile ranges (1.349 deviations) as scales; no
    correlations, those of tanh scores, and those of spatial signs."""
    at = [0.25, 0.5, 0.75]
    q = rows.groupBy("grp").agg(F.array(*[F.percentile_approx(F.col("x")[i], at, 2000) for i in range(D)]).alias("q"))
    q = written(q.select("grp", F.flatten("q").alias("q")), "op6-quartiles")

    def scores(b: pa.RecordBatch) -> np.ndarray:
        low, middle, high = np.moveaxis(matrix(b, "q", 3 * D).reshape(-1, D, 3), 2, 0)
        return (matrix(b, "x") - middle) / np.sqrt(((high - low) / 1.349) ** 2 + least_variances(middle, matrix(b, "g")) + 1e-9)

    def add(sums: Sums, b: pa.RecordBatch) -> None:
        z = scores(b)
        for k, y in ((1, np.tanh(z)), (2, z / np.sqrt((z * z).sum(axis=1, keepdims=True) + 1e-9))):
            sums.add(b, np.full(len(z), k), y)

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                s = np.array([r[f"s{i}"] for i in range(SUMS)])
                _, c, grain = moments(s)
                low, middle, high = np.array(r["q"]).reshape(D, 3).T
                scale = (high - low) / 1.349
                shape = np.sqrt(np.maximum(np.diag(c), 1e-12))
                cor = 0.95 * c / np.outer(shape, shape)  # shrunk a little, so that there is an inverse
                np.fill_diagonal(cor, 1.0)
                kinds = [(r["start"], cor)] + ([(0, np.eye(D))] if r["start"] == 1 else [])
                out += [(r["grp"], r["up"], k, int(s[0]), *inverted(middle, x * np.outer(scale, scale), grain)) for k, x in kinds]
            yield pd.DataFrame(out, columns=["grp", "up", "start", "n", "m", "v", "i", "det"])

    return summed(rows.join(q, "grp"), add).join(q, "grp").mapInPandas(fits, FIT)


def fit(rows: DataFrame, cover=COVER, steps=STEPS, prior=PRIOR) -> DataFrame:
    """(grp, up, x, g), x and g arrays of D doubles, without nulls -> the fit (FIT) of least determinant per
    group; ``up`` names the group whose fit it leans on; grains g of 0 for statistics that aren't counts."""
    scale = cover / chi2_cdf(chi2_quantile(cover, D), D + 2)
    fits = written(starts(rows), "op6-fit")

    def add(sums: Sums, b: pa.RecordBatch) -> None:
        near = to_fits(b) <= b.column("edge").to_numpy()
        sums.add(b, b.column("start").to_numpy(), matrix(b, "x"), near)

    def step(fits: DataFrame) -> DataFrame:
        d2 = with_distance(measured(rows, fits), ["grp", "start"])
        nearest = d2.groupBy("grp", "start").agg(F.percentile_approx("d2", cover, 2000).alias("edge"))
        # Written with the fit, so that Spark knows its size and needn't deal rows by group.
        edges = written(fits.join(nearest, ["grp", "start"]), "op6-edges")
        return written(invert(summed(measured(rows, edges, "edge"), add), scale, prior), "op6-fit")

    for _ in range(TRIALS):
        fits = step(fits)
    # Ties go to the first start.
    best = fits.groupBy("grp", "up").agg(F.min(F.struct("det", "start", "n", "m", "v", "i")).alias("f"))
    fits = written(best.select("grp", "up", "f.start", "f.n", "f.m", "f.v", "f.i", "f.det"), "op6-best")
    for _ in range(steps - TRIALS):
        after = step(fits)
        # The least determinant is kept: approximate edges may let it rise again.
        both = fits.withColumnRenamed("det", "was").join(after.select("grp", F.struct("n", "m", "v", "i", "det").alias("f")), "grp")
        better = F.col("f.det") < F.col("was")
        fell = both.agg(F.max(F.col("was") - F.col("f.det"))).first()[0]  # one number
        kept = [F.when(better, F.col(f"f.{c}")).otherwise(F.col("was" if c == "det" else c)).alias(c) for c in ("n", "m", "v", "i", "det")]
        fits = written(both.select("grp", "up", "start", *kept), "op6-fit")
        if fell is None or fell < STILL:
            break
    return fits


def judge(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", cover=COVER, steps=STEPS, prior=PRIOR, reject=REJECT) -> DataFrame:
    """docs with the base counts, base_failed, distance (null where that failed) and kept."""
    outputs = [*BASIC, "base_failed", "distance", "kept"]
    lang, source = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (lang_col, source_col)]
    own = docs.withColumns({"__lang": lang, "__grp": F.concat_ws("\x1f", lang, source)}).drop(*outputs)
    own = own.withColumn("__stats", basic_stats(F.col(text_col)))
    own = own.select("*", F.col("__stats.*"), vector("__stats").alias("__x"), grains("__stats").alias("__g")).drop("__stats", text_col)
    own = written(own.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "op6-stats")
    passed = own.filter(~F.col("base_failed"))
    # Every row counts in its group and in its language.
    rows = passed.select(F.explode(F.array(F.struct(F.col("__grp").alias("grp"), F.col("__lang").alias("up")), F.struct(F.col("__lang").alias("grp"), F.lit(None).cast("string").alias("up")))).alias("of"), F.col("__x").alias("x"), F.col("__g").alias("g"))
    fits = fit(rows.select("of.grp", "of.up", "x", "g"), cover, steps, prior).filter("up is not null")
    # Rows without a fit are those that failed the base rule in groups where all did.
    near = own.withColumnsRenamed({"__grp": "grp", "__x": "x", "__g": "g"}).join(fits.select("grp", "m", "v", "i"), "grp", "left")
    zeros = lambda c, n=D: F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), n)).alias(c)
    kept = [c for c in near.columns if c not in ("grp", "x", "g", "m", "v", "i") and not c.startswith("__")]
    judged = with_distance(near.select(*kept, "x", "g", zeros("m"), zeros("v"), zeros("i", len(PAIRS))), kept)
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2"))).drop("d2")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= math.sqrt(chi2_quantile(1 - reject, D))))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
