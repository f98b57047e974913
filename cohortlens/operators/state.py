"""State representations fitted on training samples and applied to all cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.errors import StateError
from cohortlens.functions.sparse import DENSE, SparseRows
from cohortlens.operators import factorisation, metrics, network, prep
from cohortlens.operators.projection import packed
from cohortlens.schema import Cohort
from cohortlens.storage import stored


#: Genes up to which one pass sums the whole covariance of values.
NARROW = 512


@dataclass(frozen=True)
class Scaler:
    """Training mean and population deviation (1 where that is 0) of each program, in order."""

    programs: tuple[int, ...]
    mean: np.ndarray
    deviation: np.ndarray


def scaler(scores: DataFrame, training: list[str]) -> Scaler:
    rows = scores.where(F.col("sample_id").isin(training)).groupBy("program_idx").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).orderBy("program_idx").collect()
    if not rows:
        raise StateError("there are no training cells")
    s = np.array([r["s"] for r in rows])
    return Scaler(tuple(r["program_idx"] for r in rows), np.array([r["m"] for r in rows]), np.where(s > 0, s, 1.0))


def _by_number(programs: tuple[int, ...], values: np.ndarray) -> F.Column:
    """A program's number in an array of constants."""
    return F.create_map(*[x for k, v in zip(programs, values) for x in (F.lit(k), F.lit(float(v)))])[F.col("program_idx")]


def standardized(scores: DataFrame, training: list[str], by: Scaler | None = None) -> DataFrame:
    """Scores less their training mean over their population deviation."""
    by = by or scaler(scores, training)
    score = (F.col("score") - _by_number(by.programs, by.mean)) / _by_number(by.programs, by.deviation)
    return scores.select(*prep.ON, "program_idx", score.alias("score"))


def unstandardized(scores: DataFrame, by: Scaler) -> DataFrame:
    """The inverse of ``standardized``."""
    score = F.col("score") * _by_number(by.programs, by.deviation) + _by_number(by.programs, by.mean)
    return scores.select(*prep.ON, "program_idx", score.alias("score"))


def packed_scores(scores: DataFrame) -> DataFrame:
    """sample_id, cell_id and x, a cell's scores in order of the programs."""
    return scores.groupBy(*prep.ON).agg(F.sort_array(F.collect_list(F.struct("program_idx", "score"))).alias("s")).select(*prep.ON, F.col("s.score").alias("x"))


def _standardized_rows(rows: DataFrame, by: Scaler) -> DataFrame:
    """Packed scores, each less its program's mean over its deviation."""
    mean, deviation = (F.array(*[F.lit(float(v)) for v in x]) for x in (by.mean, by.deviation))
    return rows.withColumn("x", F.transform("x", lambda v, i: (v - F.get(mean, i)) / F.get(deviation, i)))


def _matrix(batch: pd.DataFrame, column: str = "x") -> np.ndarray:
    return np.array(batch[column].tolist(), float).reshape(len(batch), -1)


def covariance(rows: DataFrame) -> np.ndarray:
    """Mean products of packed scores over all rows; one K x K array a task leaves the executors."""
    total = network.summed(rows, lambda b: np.r_[len(b), (_matrix(b).T @ _matrix(b)).ravel()])
    k = int(np.sqrt(len(total) - 1))
    return total[1:].reshape(k, k) / total[0]


def principal(c: np.ndarray, n_components: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes as rows, largest first, the largest entry of each positive; and their shares of variance."""
    if not 0 < n_components <= len(c):
        raise StateError(f"{n_components} components of {len(c)} dimensions")
    values, vectors = np.linalg.eigh(c)
    axes = vectors.T[::-1][:n_components]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return axes, values[::-1][:n_components] / max(values.sum(), 1e-300)


@dataclass(frozen=True)
class Linear:
    """Principal axes (rows) over standardised or centred values, and their shares of variance."""

    axes: np.ndarray
    shares: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        by = self.axes.T / self.deviation[:, None]  # values may be sparse, so they aren't centred first
        return x @ by - self.mean @ by

    def inverse(self, c: np.ndarray) -> np.ndarray:
        return c @ self.axes * self.deviation + self.mean


@dataclass(frozen=True)
class Nonlinear:
    """A tanh bottleneck between two layers, over standardised scores."""

    layers: list
    mean: np.ndarray
    deviation: np.ndarray

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        w, b = self.layers[0]
        return np.tanh((x - self.mean) / self.deviation @ w + b)

    def inverse(self, c: np.ndarray) -> np.ndarray:
        w, b = self.layers[1]
        return (c @ w + b) * self.deviation + self.mean


def model_arrays(model: Linear | Nonlinear) -> dict[str, np.ndarray]:
    """What has to be kept of a model."""
    own = {"mean": model.mean, "deviation": model.deviation}
    if isinstance(model, Linear):
        return own | {"axes": model.axes, "shares": model.shares}
    return own | network.layer_arrays(model.layers)


def model_from(arrays: dict[str, np.ndarray]) -> Linear | Nonlinear:
    if "axes" in arrays:
        return Linear(arrays["axes"], arrays["shares"], arrays["mean"], arrays["deviation"])
    return Nonlinear(network.layers_from(arrays), arrays["mean"], arrays["deviation"])


COORDINATES = "sample_id string, cell_id string, coordinates array<double>"


def coordinates(rows: DataFrame, model: Linear | Nonlinear, values: Callable[[pd.DataFrame], np.ndarray] = _matrix) -> DataFrame:
    """Coordinates of every row by a fitted model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[prep.ON].assign(coordinates=list(model.coordinates(values(batch))))

    return rows.mapInPandas(run, COORDINATES)


def inverse(found: DataFrame, model: Linear | Nonlinear) -> DataFrame:
    """sample_id, cell_id and x: the values that coordinates stand for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[prep.ON].assign(x=list(model.inverse(_matrix(batch, "coordinates"))))

    return found.mapInPandas(run, "sample_id string, cell_id string, x array<double>")


def linear_state(scores: DataFrame, training: list[str], n_components: int, rows: DataFrame | None = None) -> tuple[DataFrame, Linear]:
    """Principal coordinates of standardised scores, and the model; ``rows`` are the same scores packed, if they are at hand."""
    by = scaler(scores, training)
    z = stored(_standardized_rows(packed_scores(scores) if rows is None else rows, by))
    train = z.where(F.col("sample_id").isin(training))
    if n_components > train.limit(n_components).count():
        raise StateError(f"{n_components} components of fewer cells")
    axes, shares = principal(covariance(train), n_components)
    plain = Linear(axes, shares, np.zeros(axes.shape[1]), np.ones(axes.shape[1]))
    return coordinates(z, plain), Linear(axes, shares, by.mean, by.deviation)


def expression_pca(cohort: Cohort, training: list[str], n_components: int, max_iter: int = 200, tol: float = 1e-11, seed: int = 0) -> tuple[DataFrame, Linear]:
    """Principal coordinates of the centred values, on any number of genes.

    Up to ``NARROW`` genes the covariance is summed in one pass. Beyond it:
    subspace iteration from a random start: a pass sums genes x (components +
    10) products over the tasks, centred by the means, and no array of genes x
    genes is made. Ends when what the axes leave of their products is at most
    ``tol`` of the largest variance.
    """
    names = [r["gene_id"] for r in cohort.genes.orderBy("gene_pos").collect()]
    g = len(names)
    rows = stored(packed(cohort, names))
    cells = stored(factorisation.blocks(rows.where(F.col("sample_id").isin(training)).withColumn("sample_id", F.lit(""))))
    whole = lambda of: factorisation.summed_blocks(cells, {"": [0]}, g, of).get(("", 0))
    total = whole(lambda x, *_: np.r_[len(x), x.squares().sum(), x.transposed(np.ones((len(x), 1)))[:, 0]])
    if total is None:
        raise StateError("there are no training cells")
    n, mean = total[0], total[2:] / total[0]
    if not 0 < n_components <= g:
        raise StateError(f"{n_components} components of {g} dimensions")
    if g <= NARROW:
        squares = whole(lambda x, *_: sum(d.T @ d for d in x.dense(DENSE // 4)).ravel()).reshape(g, g)
        values, vectors = np.linalg.eigh(squares / n - np.outer(mean, mean))
        values, axes = values[::-1][:n_components], vectors.T[::-1][:n_components]
        return _by_axes(rows, axes, values, max(total[1] / n - mean @ mean, 1e-300), mean)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((g, min(g, n_components + 10))))[0]
    for _ in range(max_iter):
        image = whole(lambda x, *_: x.transposed(x @ basis).ravel()).reshape(g, -1) / n - np.outer(mean, mean @ basis)  # noqa: B023
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1][:n_components], turn[:, ::-1][:, :n_components]
        axes = (basis @ turn).T
        if np.linalg.norm((image @ turn).T - values[:, None] * axes, axis=1).max() <= tol * max(values[0], 1e-300):
            break
        basis = np.linalg.qr(image)[0]
    return _by_axes(rows, axes, values, max(total[1] / n - mean @ mean, 1e-300), mean)


def _by_axes(rows: DataFrame, axes: np.ndarray, values: np.ndarray, trace: float, mean: np.ndarray) -> tuple[DataFrame, Linear]:
    """Coordinates of packed cells on axes, the largest entry of each made positive, and the model."""
    g = len(mean)
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    model = Linear(axes, values / trace, mean, np.ones(g))
    return coordinates(rows, model, lambda b: SparseRows.packed(b, g)), model


def nonlinear_state(scores: DataFrame, training: list[str], n_components: int, max_iter: int = 500, seed: int = 0, alpha: float = 1e-4, rows: DataFrame | None = None) -> tuple[DataFrame, Nonlinear]:
    """Coordinates of standardised scores in the bottleneck of an autoencoder, fitted on all training cells; ``rows`` as in ``linear_state``."""
    by = scaler(scores, training)
    z = stored(_standardized_rows(packed_scores(scores) if rows is None else rows, by))
    k = len(by.programs)
    layers = network.trained(z.where(F.col("sample_id").isin(training)), lambda b: (_matrix(b), _matrix(b)), [k, n_components, k], max_iter, seed, alpha, tanh=True)
    return coordinates(z, Nonlinear(layers, np.zeros(k), np.ones(k))), Nonlinear(layers, by.mean, by.deviation)


@dataclass(frozen=True)
class Fitted:
    """A state of every cell: coordinates, and what measures how well it gives the cells back."""

    coordinates: DataFrame
    rows: DataFrame
    values: Callable[[pd.DataFrame], np.ndarray]
    model: Linear | Nonlinear | None
    at_once: int = 10_000

    def reconstruction(self, split: DataFrame) -> DataFrame:
        return metrics.model_reconstruction(self.rows, split, self.values, self.model, self.at_once)


def fitted(method: str, scores: DataFrame, cohort: Cohort, training: list[str], n_components: int, seed: int = 0, most_elements: int = DENSE, rows: DataFrame | None = None) -> Fitted:
    """One of METHODS, fitted on the training samples and applied to all cells; a task makes ``most_elements`` dense values at a time.

    ``rows`` are the scores packed (``packed_scores``) as a stored table, if several methods are fitted on them.
    """
    if method == "pca":
        found, model = expression_pca(cohort, training, n_components, seed=seed)
        genes = [r["gene_id"] for r in cohort.genes.orderBy("gene_pos").collect()]
        return Fitted(found, packed(cohort, genes), lambda b: np.asarray(SparseRows.packed(b, len(genes))), model, max(1, most_elements // len(genes)))
    rows = stored(packed_scores(scores)) if rows is None else rows
    if method == "direct":
        return Fitted(_standardized_rows(rows, scaler(scores, training)).withColumnRenamed("x", "coordinates"), rows, _matrix, None)
    if method not in METHODS:
        raise StateError(f"{method} isn't one of {', '.join(METHODS)}")
    found, model = linear_state(scores, training, n_components, rows) if method == "linear" else nonlinear_state(scores, training, n_components, seed=seed, rows=rows)
    return Fitted(found, rows, _matrix, model)


METHODS = ("direct", "linear", "nonlinear", "pca")
