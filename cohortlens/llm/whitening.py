"""Whitening of embeddings: principal components by MLlib's SVD of the centred distributed rows.

Entries become integers on a grid of 1/``SCALE``, so counts, sums and squared
deviations are exact. Each distinct vector is fitted once; repeats combine on
the map side before they are shuffled. Rows are centred as integers (``n * x -
S``) and divided once, so nothing is lost to cancellation, and go to
``RowMatrix.computeSVD``, which sums products over tasks; the driver gets
numbers by dimensions only. A singular value s stands for the variance s * s / n.
The total variance isn't the sum of what was found: it comes from the exact
deviations. Vectors are then projected in Arrow batches, and the covariance of
the whitened fit list is summed anew as a check.

Edge cases: rows whose vector is null or holds a null, NaN or infinite entry are
dropped, as are empty vectors and those of another length than most (the longer
length in a tie); rows of equal vectors are fitted once and all returned; a null
id stays; components whose variance is at most ``LEAST`` of the largest (fewer
distinct vectors than dimensions, constant entries) can't be scaled and aren't
returned, so one distinct vector or an empty table gives an empty result; an
entry or a deviation that a long can't hold raises; other columns of the input,
whatever their names, aren't returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

#: Steps of the integer grid in a unit, and what is added so that usual entries are positive.
SCALE, OFFSET = 64, 1_000_000
#: Share of the largest variance that a component needs.
LEAST = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was fitted; ``vectors`` has a component a row, ``fit_list`` each distinct grid vector (``_x``)."""

    fit_list: DataFrame
    n: int
    sums: list[int]
    total: Fraction
    vectors: np.ndarray
    variances: np.ndarray

    @property
    def explained(self) -> list[float]:
        """Share of each component in the total variance."""
        return [float(Fraction(float(e)) / self.total) for e in self.variances]


def on_grid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and ``_x``, the integer vector, of every row that can be used."""
    usable = F.forall(F.col(vec_col), lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    sound = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & usable)
    most = sound.groupBy(F.size(vec_col).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return vectors.limit(0).select(F.col(id_col).alias("vec_id"), F.lit(None).cast("array<bigint>").alias("_x"))
    held = lambda d: F.when(F.abs(d) < 1e17, F.floor(d)).otherwise(F.raise_error(F.lit("an entry is too large for the integer grid")).cast("long"))
    return sound.where(F.size(vec_col) == most.dim).select(F.col(id_col).alias("vec_id"), F.transform(vec_col, lambda e: held(SCALE * e.cast("double")) + OFFSET).alias("_x"))


def _from_mean(n: int, sums: list[int]) -> Column:
    """``n`` times the distance of each entry from the mean, exactly."""
    return F.zip_with("_x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: n * x - s)


def deviation(of: Column) -> Column:
    """Sum of the squares of exact distances."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.aggregate(of, F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + wide(c) * wide(c)).cast("decimal(38,0)"))


def _matrix(rows: DataFrame, column: Column, n: int, dim: int) -> RowMatrix:
    """A column of arrays as MLlib's matrix; rows stay in the JVM."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"), n, dim)


def fitted(grid: DataFrame, k: int = 16) -> Whitening | None:
    """The first ``k`` components of the distinct vectors of ``grid``; None if nothing varies."""
    fit_list = stored(grid.select("_x").distinct(), "whitening-fit")
    sums = {r.pos: (r.s, r.n) for r in fit_list.select(F.posexplode("_x").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()}
    if not sums:
        return None
    n, s = sums[0][1], [sums[i][0] for i in range(len(sums))]
    centred = _from_mean(n, s)
    total = fit_list.agg(F.sum(deviation(centred))).first()[0]
    if not total:
        return None
    # all components are asked for, so that the Gram matrix is decomposed as a whole, to double precision
    svd = _matrix(fit_list, F.transform(centred, lambda c: c.cast("double") / n), n, len(s)).computeSVD(len(s))
    variances = np.array(svd.s.toArray()) ** 2 / n
    vectors = np.array(svd.V.toArray()).reshape(len(s), -1).T
    kept = np.flatnonzero(variances > LEAST * variances[0])[:k]
    vectors = vectors[kept]
    vectors *= np.sign(vectors[np.arange(len(kept)), np.abs(vectors).argmax(1)])[:, None]  # the largest entry is positive
    return Whitening(fit_list, n, s, Fraction(int(total), n**3), vectors, variances[kept])


def projected(grid: DataFrame, of: Whitening) -> DataFrame:
    """``grid`` with ``_c`` (``n`` times the distances from the mean) and ``_w`` (an array, one whitened value a component)."""
    n, scaled = of.n, (of.vectors / np.sqrt(of.variances)[:, None]).T

    @F.pandas_udf("array<double>")
    def whiten(centred: pd.Series) -> pd.Series:
        if not len(centred):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.vstack(centred.to_numpy()).astype(np.float64) / n) @ scaled))

    rows = grid.withColumn("_c", _from_mean(n, of.sums))
    return rows.withColumn("_w", whiten("_c"))


def identity_error(of: Whitening) -> float:
    """Largest absolute difference of the whitened fit list's covariance (divisor ``n``) from the identity."""
    k = len(of.variances)
    rows = stored(projected(of.fit_list, of).select("_w"), "whitening-check")
    found = _matrix(rows, F.col("_w"), of.n, k).computeCovariance().toArray() * (of.n - 1) / of.n
    return float(np.abs(found - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of every usable row and component."""
    grid = on_grid(vectors, id_col, vec_col)
    of = fitted(grid, k)
    if of is None:
        return grid.limit(0).selectExpr("vec_id", "0 AS component", "0L AS n", "CAST(0 AS decimal(38,0)) AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    shares = F.array(*[F.lit(e) for e in of.explained])
    rows = projected(grid, of).select("vec_id", deviation(F.col("_c")).alias("deviation"), F.posexplode("_w").alias("_p", "whitened"))
    return rows.select("vec_id", (F.col("_p") + 1).alias("component"), F.lit(of.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("_p")].alias("explained"), F.lit(identity_error(of)).alias("identity_error"))
