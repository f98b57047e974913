"""Programs of each sample on its own: group means, non-negative factors, and their stability over restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.errors import ProgramError
from cohortlens.functions import kernels
from cohortlens.functions.sparse import DENSE
from cohortlens.operators import factorisation, prep
from cohortlens.operators.projection import packed
from cohortlens.schema import PROGRAMS, Cohort
from cohortlens.storage import stored

#: (matrix, number of programs, seed) -> programs x genes, or that, the sweeps made (below 0 if they ran out) and the error
Estimator = Callable[[np.ndarray, int, int], np.ndarray | tuple[np.ndarray, int, float]]


def normalised(programs: DataFrame) -> DataFrame:
    """Each program's weights sum to 1; a program without weight raises when read."""
    total = F.sum("weight").over(Window.partitionBy("sample_id", "program_idx"))
    return programs.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.raise_error(F.lit("a program has no weight")).cast("double")))


def mean_programs(cohort: Cohort) -> DataFrame:
    """One program per sample and lineage: mean value of each gene over all its cells, zeros kept, summing to 1."""
    groups = cohort.cells.groupBy("sample_id", "lineage").agg(F.count("*").alias("n"))
    order = F.dense_rank().over(Window.partitionBy("sample_id").orderBy("lineage")) - 1
    groups = groups.withColumn("program_idx", order)
    sums = cohort.expr.join(cohort.cells.select(*prep.ON, "lineage"), prep.ON).groupBy("sample_id", "lineage", "gene_id").agg(F.sum("value").alias("s"))
    genes = cohort.genes.withColumn("_place", F.row_number().over(Window.orderBy("gene_pos")))  # the gene axis, one row a gene
    axis = groups.withColumn("_place", F.explode(F.sequence(F.lit(1), F.lit(cohort.genes.count())))).join(genes, "_place")
    full = axis.join(sums, ["sample_id", "lineage", "gene_id"], "left")
    return normalised(full.select("sample_id", "program_idx", "lineage", "gene_id", "gene_pos", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("weight")))


@dataclass(frozen=True)
class Nmf:
    """Factorisation with penalties on activities and weights (the same unless ``alpha_h`` is given); an estimator that Spark can also spread."""

    max_iter: int = 500
    tol: float = 1e-4
    alpha_w: float = 0.0
    alpha_h: float | None = None
    l1_ratio: float = 0.0

    def __post_init__(self):
        if self.max_iter < 1 or self.tol < 0 or min(self.alpha_w, self.on_weights) < 0 or not 0 <= self.l1_ratio <= 1:
            raise ProgramError("max_iter has to be positive, tol and penalties can't be negative, l1_ratio is a share")

    @property
    def on_weights(self) -> float:
        return self.alpha_w if self.alpha_h is None else self.alpha_h

    def __call__(self, matrix: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, int, float]:
        activities, weights, sweeps = kernels.nmf(matrix, k, seed, self.max_iter, self.tol, self.alpha_w, self.on_weights, self.l1_ratio)
        step = max(1, DENSE // matrix.shape[1])
        squares = sum(np.linalg.norm(matrix[i : i + step] - activities[i : i + step] @ weights) ** 2 for i in range(0, len(matrix), step))
        return weights, sweeps if sweeps < self.max_iter else -sweeps, float(np.sqrt(squares))


nmf_estimator = Nmf
_nmf = Nmf()


def diagnostics(runs: DataFrame) -> DataFrame:
    """sample_id, run, n_iter, converged and error (of the whole fit) of fitted programs; null for estimators that don't say."""
    found = runs.groupBy("sample_id", "run").agg(F.max("sweeps").alias("s"), F.max("error").alias("error"))
    return found.select("sample_id", "run", F.abs("s").alias("n_iter"), (F.col("s") > 0).alias("converged"), "error")


RUNS = f"{PROGRAMS}, run int, sweeps int, error double"


def fitted_programs(cohort: Cohort, n_programs: int = 8, seed: int = 0, repeats: int = 1, estimator: Estimator = _nmf, own_axis: bool = False, task_elements: int = 8_000_000) -> DataFrame:
    """Programs of every sample and restart: PROGRAMS, ``run``, ``sweeps`` (below 0 if they ran out) and ``error``.

    Samples are never pooled. A sample of at most ``task_elements`` values,
    zeros counted, is fitted in one task for each restart; the cells of a larger
    one stay spread (``factorisation``), with the same result. Estimators other
    than ``Nmf`` ask for a sample's whole matrix and raise beyond the bound.
    With ``own_axis`` a sample's axis is the genes that it has.
    """
    genes = cohort.genes.count()
    sizes = {r["sample_id"]: r["n"] for r in cohort.cells.groupBy("sample_id").agg(F.count("*").alias("n")).collect()}
    large = sorted(s for s, n in sizes.items() if n * genes > task_elements)
    if not large:
        return _in_tasks(cohort, n_programs, seed, repeats, estimator, own_axis)
    if not isinstance(estimator, Nmf):
        raise ProgramError(f"samples {large}: their dense matrices exceed {task_elements} elements; select genes, split them or use Nmf")
    spread = _spread(cohort, {s: sizes[s] for s in large}, n_programs, seed, repeats, estimator, own_axis)
    rest = [s for s in sizes if s not in set(large)]
    return spread.unionByName(_in_tasks(cohort.kept_samples(rest), n_programs, seed, repeats, estimator, own_axis)) if rest else spread


def _program_rows(sample: str, run: int, weights: np.ndarray, names: list[str], positions: list[int], sweeps: int | None, error: float | None) -> pd.DataFrame:
    """The rows of a fit, each program summing to 1."""
    sums = weights.sum(1, keepdims=True)
    if (sums <= 0).any():
        raise ProgramError(f"sample {sample}: a program is empty")
    k = len(weights)
    return pd.DataFrame({
        "sample_id": sample, "program_idx": np.repeat(np.arange(k, dtype=np.int32), len(names)), "gene_id": np.tile(names, k), "gene_pos": np.tile(positions, k),
        "weight": (weights / sums).ravel(), "run": np.int32(run), "sweeps": pd.array([sweeps] * weights.size, "Int32"), "error": error,
    })


def _spread(cohort: Cohort, sizes: dict[str, int], n_programs: int, seed: int, repeats: int, estimator: Nmf, own_axis: bool) -> DataFrame:
    """As ``_in_tasks`` on the samples of ``sizes`` (their cells), without a task that holds a sample."""
    axis = cohort.genes.orderBy("gene_pos").collect()
    names, positions = np.array([r["gene_id"] for r in axis]), np.array([r["gene_pos"] for r in axis])
    spark, parts = cohort.cells.sparkSession, []
    cells = packed(cohort.kept_samples(list(sizes)), names.tolist())
    n_values = sum(sizes.values()) * len(names)
    for sample, run, here, fit in factorisation.factorised(cells, list(sizes), n_values, len(names), n_programs, seed, repeats, estimator.max_iter, estimator.tol, estimator.alpha_w, estimator.on_weights, estimator.l1_ratio, own_axis):
        sweeps = fit.sweeps if fit.sweeps < estimator.max_iter else -fit.sweeps
        rows = _program_rows(sample, run, fit.h, names[here], positions[here], sweeps, fit.error)
        parts.append(spark.createDataFrame(rows, RUNS))
    return stored(reduce(DataFrame.unionByName, parts))


def _in_tasks(cohort: Cohort, n_programs: int, seed: int, repeats: int, estimator: Estimator, own_axis: bool) -> DataFrame:
    """A task holds a sample's matrix, which is filled from batches of packed cells, and no row of a value."""
    axis = {r["gene_id"]: r["gene_pos"] for r in cohort.genes.collect()}
    names = [g for g, _ in sorted(axis.items(), key=lambda x: x[1])]
    positions = [axis[g] for g in names]
    runs = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    cells = cohort.cells.groupBy("sample_id").agg(F.count("*").alias("n"))
    rows = packed(cohort, names, "cell_pos").join(cells, "sample_id").select("sample_id", runs.alias("run"), "cell_pos", "n", "places", "found")

    def matrix(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Cells in the order of their positions, whatever order they come in."""
        x, order, at = np.zeros((0, len(names))), [], 0
        for batch in batches:
            if not at:
                x = np.zeros((batch.column("n")[0].as_py(), len(names)))
            sizes = pc.fill_null(pc.list_value_length(batch.column("places")), 0).to_numpy(zero_copy_only=False)
            x[at + np.repeat(np.arange(len(sizes)), sizes), batch.column("places").flatten().to_numpy()] = batch.column("found").flatten().to_numpy()
            order.append(batch.column("cell_pos").to_numpy(zero_copy_only=False))
            at += len(sizes)
        place = np.argsort(np.concatenate(order), kind="stable")
        for j in range(x.shape[1]):  # a column at a time, without a second matrix
            x[:, j] = x[place, j]
        return x

    def fit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, run = (k.as_py() for k in key)
        x = matrix(batches)
        n, here = len(x), np.flatnonzero(x.any(0)) if own_axis else np.arange(len(names))
        if n < 2 or n_programs > min(n, len(here)):
            raise ProgramError(f"sample {sample}: {n_programs} programs of {n} cells and {len(here)} genes")
        x = x if len(here) == len(names) else x[:, here]
        found = estimator(x, n_programs, seed + int(run))
        found, sweeps, error = found if isinstance(found, tuple) else (found, None, None)
        weights = np.asarray(found, float)
        if weights.shape != (n_programs, len(here)) or (weights < 0).any():
            raise ProgramError(f"sample {sample}: the estimator returned {weights.shape}")
        out = _program_rows(sample, int(run), weights, [names[i] for i in here], [positions[i] for i in here], sweeps, error)
        yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    kinds = pa.schema([("sample_id", pa.string()), ("program_idx", pa.int32()), ("gene_id", pa.string()), ("gene_pos", pa.int32()), ("weight", pa.float64()), ("run", pa.int32()), ("sweeps", pa.int32()), ("error", pa.float64())])
    return rows.groupBy("sample_id", "run").applyInArrow(fit, RUNS)


def stabilised(runs: DataFrame, min_similarity: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Consensus programs of each sample over its restarts, and how each anchor program was matched.

    Restart 0 is the anchor. A program stays if in every other restart its
    match under the best assignment is similar enough; its weights are the
    medians over restarts.
    """

    def match(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tables = {r: g.pivot(index="program_idx", columns="gene_pos", values="weight").to_numpy() for r, g in part.groupby("run")}
        anchor = tables.pop(0)
        out = [(key[0], 0, k, k, 1.0) for k in range(len(anchor))]
        for run, other in sorted(tables.items()):
            similarity = kernels.rank_similarity(anchor, other)
            out += [(key[0], run, int(a), int(b), float(similarity[a, b])) for a, b in zip(*kernels.assignment(similarity))]
        frame = pd.DataFrame(out, columns=["sample_id", "run", "anchor_idx", "matched_idx", "similarity"])
        lowest = frame.groupby("anchor_idx")["similarity"].transform("min")
        return frame.assign(retained=lowest >= min_similarity)

    stability = runs.groupBy("sample_id").applyInPandas(match, "sample_id string, run int, anchor_idx int, matched_idx int, similarity double, retained boolean")
    kept = stability.where("retained").select("sample_id", "run", F.col("matched_idx").alias("program_idx"), "anchor_idx")
    joined = runs.join(kept, ["sample_id", "run", "program_idx"])
    medians = joined.groupBy("sample_id", "anchor_idx", "gene_id", "gene_pos").agg(F.median("weight").alias("weight"))
    order = F.dense_rank().over(Window.partitionBy("sample_id").orderBy("anchor_idx")) - 1
    return normalised(medians.select("sample_id", order.alias("program_idx"), "gene_id", "gene_pos", "weight")), stability
