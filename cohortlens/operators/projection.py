"""Projection of cells on a frozen vocabulary: solvers per cell in Arrow batches, after one packing shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.errors import ProjectionError
from cohortlens.functions import kernels
from cohortlens.functions.sparse import DENSE, SparseRows, dense_parts
from cohortlens.operators import network, prep, scoring
from cohortlens.schema import Cohort
from cohortlens.storage import stored

STATES = "sample_id string, cell_id string, usages array<double>, states array<double>, projection_error double, relative_error double, observed_coverage double, uncertainty array<double>"
#: (cells x genes values, genes x programs basis) -> usages, or usages and their uncertainty. The solvers here take SparseRows, others get a dense array.
Solver = Callable[[SparseRows | np.ndarray, np.ndarray], np.ndarray | tuple[np.ndarray, np.ndarray]]


def basis_of(vocabulary: DataFrame) -> tuple[list[str], np.ndarray]:
    """Gene ids in order and the genes x programs weights; a vocabulary is small."""
    table = vocabulary.toPandas().pivot(index=["gene_pos", "gene_id"], columns="program_idx", values="weight").fillna(0.0).sort_index()
    return [g for _, g in table.index], table.to_numpy()


def on_sparse(solve: Solver) -> Solver:
    """Marks a solver that takes sparse rows as they are."""
    solve.on_sparse = True
    return solve


@on_sparse
def nnls(values: SparseRows, basis: np.ndarray) -> np.ndarray:
    return kernels.nonnegative_quadratics(basis.T @ basis, values @ basis)


def regularized_nnls(l1: float = 0.0, l2: float = 0.0) -> Solver:
    """Exact minimum of the penalised squares."""
    if l1 < 0 or l2 < 0 or not l1 + l2 > 0:
        raise ProjectionError("penalties can't be negative, and one has to be positive")

    @on_sparse
    def solve(values: SparseRows, basis: np.ndarray) -> np.ndarray:
        return kernels.nonnegative_quadratics(basis.T @ basis + l2 * np.eye(basis.shape[1]), values @ basis - l1)

    return solve


@on_sparse
def simplex(values: SparseRows, basis: np.ndarray) -> np.ndarray:
    """Shares that sum to 1, fitted to values as shares; the error is still against the raw values."""
    linear = (values @ basis) / np.maximum(values.totals(), 1e-300)[:, None]
    return kernels.nonnegative_quadratics(basis.T @ basis, linear, 1.0)


def _whole(values: SparseRows) -> None:
    if (values.found != np.floor(values.found)).any():
        raise ProjectionError("counts have to be whole numbers")


def poisson(max_iter: int = 1000, tol: float = 1e-8) -> Solver:
    @on_sparse
    def solve(values: SparseRows, basis: np.ndarray) -> np.ndarray:
        _whole(values)
        return kernels.mixture_em(values, basis, max_iter, tol)

    return solve


def negative_binomial(dispersion: float = 0.1, max_iter: int = 200, tol: float = 1e-7) -> Solver:
    @on_sparse
    def solve(values: SparseRows, basis: np.ndarray) -> np.ndarray:
        _whole(values)
        return kernels.mixture_em(values, basis, max_iter, tol, dispersion)

    return solve


def variational(n_samples: int = 8, seed: int = 0, noise_scale: float = 0.05) -> Solver:
    """Mean and deviation of NNLS over noisy copies; a cell's draws depend on its own values alone, not on its batch."""

    def solve(values: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = values.shape
        words = np.frombuffer(np.uint64(seed).tobytes(), np.uint32)[: 1 if seed < 1 << 32 else 2]  # as numpy reads the seed itself
        seeds = np.hstack([np.tile(words, (n, 1)), np.ascontiguousarray(values, np.float64).view(np.uint32)])
        linear, step = np.zeros((n, n_samples, basis.shape[1])), max(1, DENSE // 4 // (n_samples * max(1, width)))
        for a in range(0, n, step):
            x = values[a : a + step, None]
            draws = np.empty((len(x), n_samples, width))
            for own, out in zip(seeds[a : a + step], draws):  # words in one array: a list of them is taken apart word by word
                np.random.default_rng(own).standard_normal(out=out)
            linear[a : a + step] = np.maximum(x + draws * noise_scale * np.sqrt(x + 1), 0) @ basis
        every = kernels.nonnegative_quadratics(basis.T @ basis, linear.reshape(n * n_samples, -1)).reshape(linear.shape)
        return every.mean(1), every.std(1)

    return solve


def neural_training(rows: DataFrame, n_genes: int, basis: np.ndarray, hidden: tuple[int, ...] = (32,), max_iter: int = 200, seed: int = 0, alpha: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of a network that learns the NNLS usages of all ``rows`` (packed cells) at depth 1."""

    def pairs(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        values = SparseRows.packed(batch, n_genes)
        x, y = np.asarray(values), nnls(values, basis)
        depth = np.maximum(x.sum(1, keepdims=True), 1.0)
        return x / depth, y / depth

    return network.trained(rows.select("places", "found"), pairs, [n_genes, *hidden, basis.shape[1]], max_iter, seed, alpha)


def neural(layers: list[tuple[np.ndarray, np.ndarray]]) -> Solver:
    """Usages by a fitted network; its layers are all its state, to be kept or taken from elsewhere."""

    @on_sparse
    def solve(values: SparseRows, _: np.ndarray) -> np.ndarray:
        depth = np.maximum(values.totals(), 1.0)
        return np.maximum(kernels.network_output(values.scaled(depth), layers), 0) * depth[:, None]

    return solve


PROJECTORS: dict[str, Callable[..., Solver]] = {
    "nnls": lambda: nnls, "regularized_nnls": regularized_nnls, "simplex": lambda: simplex, "poisson": poisson,
    "negative_binomial": negative_binomial, "neural": neural, "variational": variational,
}


def available_projectors() -> tuple[str, ...]:
    return tuple(PROJECTORS)


def packed(cohort: Cohort, genes: list[str], *more: str) -> DataFrame:
    """A row per cell (with the columns ``more`` of ``cells``) with its non-zero values by place in ``genes``; one shuffle by cell."""
    at = cohort.expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene_id string, at int")
    entries = cohort.expr.join(at, "gene_id").groupBy(*prep.ON).agg(F.collect_list("at").alias("places"), F.collect_list("value").alias("found"))
    return cohort.cells.select(*prep.ON, *more).join(entries, prep.ON, "left")


def _solver(method: str, rows: DataFrame, n_genes: int, basis: np.ndarray, options: dict) -> Solver:
    if method != "neural":
        return PROJECTORS[method](**options)
    return neural(options["layers"] if "layers" in options else neural_training(rows, n_genes, basis, **options))


def _prepared(cohort: Cohort, vocabulary: DataFrame, allow_empty: bool) -> tuple[DataFrame, list[str], np.ndarray]:
    """Packed cells as a stored table, the genes and the basis."""
    own, _, _ = prep.aligned(cohort, vocabulary, strict=False)
    genes, basis = basis_of(vocabulary.join(own.genes.select("gene_id"), "gene_id", "left_semi"))
    if not genes:
        raise ProjectionError("the cohort has no gene of the vocabulary")
    rows = stored(packed(own, genes))
    bare = rows.where(~F.coalesce(F.exists("found", lambda x: x > 0), F.lit(False)))  # its values may lie on extra genes
    if not allow_empty and bare.limit(1).count() and bare.join(cohort.expr.where("value > 0"), prep.ON, "left_anti").limit(1).count():
        raise ProjectionError("a cell has no values")
    return rows, genes, basis


def project(cohort: Cohort, vocabulary: DataFrame, method: str = "nnls", allow_empty: bool = False, **options) -> DataFrame:
    """STATES of every cell: usages, shares, error against the raw values, coverage.

    Genes of the vocabulary that the cohort lacks are left out; extra genes
    are ignored. A cell without any value raises unless ``allow_empty``.
    """
    if method not in PROJECTORS:
        raise ProjectionError(f"{method} isn't one of {', '.join(PROJECTORS)}")
    return _projected(*_prepared(cohort, vocabulary, allow_empty), method, options)


def batch_projector(solve: Solver, n_genes: int, basis: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function of batches of packed cells that gives their STATES."""
    sparse, gram = getattr(solve, "on_sparse", False), basis.T @ basis

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for b in batches for part in ([b] if sparse else dense_parts(b, n_genes))):
            x = SparseRows.packed(batch, n_genes)
            got = solve(x if sparse else np.asarray(x), basis)
            usages, uncertainty = got if isinstance(got, tuple) else (got, None)
            squares = x.squares()
            errors = np.sqrt(np.maximum(squares + ((usages @ gram) * usages).sum(1) - 2 * ((x @ basis) * usages).sum(1), 0))
            norms = np.sqrt(squares)
            relative = np.divide(errors, norms, out=np.where(errors > 0, np.inf, 0.0), where=norms > 0)
            total = usages.sum(1, keepdims=True)
            states = np.divide(usages, total, out=np.zeros_like(usages), where=total > 0)
            yield pd.DataFrame({
                "sample_id": batch["sample_id"].to_numpy(), "cell_id": batch["cell_id"].to_numpy(), "usages": list(usages), "states": list(states), "projection_error": errors,
                "relative_error": relative, "observed_coverage": x.present() / n_genes, "uncertainty": [None] * len(x) if uncertainty is None else list(uncertainty),
            })

    return run


def _projected(rows: DataFrame, genes: list[str], basis: np.ndarray, method: str, options: dict) -> DataFrame:
    solve = _solver(method, rows, len(genes), basis, options)
    return rows.mapInPandas(batch_projector(solve, len(genes), basis), STATES)


def compare(cohort: Cohort, vocabulary: DataFrame, methods: list[str], options: dict[str, dict] | None = None, allow_empty: bool = False) -> DataFrame:
    """States of every method, with a ``method`` column, and no selection. Cells are packed once for all methods."""
    if unknown := set(methods) - set(PROJECTORS):
        raise ProjectionError(f"{sorted(unknown)} aren't among {', '.join(PROJECTORS)}")
    ready = _prepared(cohort, vocabulary, allow_empty)
    parts = [_projected(*ready, m, dict((options or {}).get(m, {}))).withColumn("method", F.lit(m)) for m in sorted(methods)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def benchmark(states: DataFrame) -> DataFrame:
    """Mean error, share of zero states and coverage by method and sample."""
    zero = F.aggregate("states", F.lit(0.0), lambda n, x: n + F.when(x == 0, 1.0).otherwise(0.0)) / F.size("states")
    return states.groupBy("method", "sample_id").agg(F.avg("projection_error").alias("mean_error"), F.avg(zero).alias("zero_fraction"), F.avg("observed_coverage").alias("coverage"))


def findings(cohort: Cohort, vocabulary: DataFrame, states: DataFrame, error_threshold: float = 1.0) -> DataFrame:
    """By sample, what a reader of STATES should know: numbers, and ``warnings`` in words (empty if all is well).

    n_cells; n_missing and n_extra genes of the vocabulary; n_high_error cells,
    whose relative error is above the threshold; n_unused cells, without any
    usage. One count over the states, which should be a stored table.
    """
    if not 0 < error_threshold < float("inf"):
        raise ProjectionError("the threshold of relative errors has to be positive and finite")
    _, missing, extra = prep.aligned(cohort, vocabulary, strict=False)
    n_missing, n_extra = missing.count(), extra.count()
    unused = ~F.exists("usages", lambda x: x > 0)
    counts = states.groupBy("sample_id").agg(
        F.count("*").alias("n_cells"), F.lit(n_missing).cast("long").alias("n_missing"), F.lit(n_extra).cast("long").alias("n_extra"),
        F.count_if(F.col("relative_error") > error_threshold).alias("n_high_error"), F.count_if(unused).alias("n_unused"),
    )
    said = [("n_missing", "genes of the vocabulary are missing"), ("n_high_error", f"cells have a relative error above {error_threshold:g}"), ("n_unused", "cells use no program")]
    return counts.withColumn("warnings", F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}"))) for c, text in said])))


def direct(cohort: Cohort, vocabulary: DataFrame) -> DataFrame:
    return scoring.direct(cohort, vocabulary)
