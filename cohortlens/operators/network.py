"""Small regression networks fitted on all rows of a table: each step sums gradients over the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.errors import StateError
from cohortlens.functions import kernels
from cohortlens.functions.sparse import dense_parts
from cohortlens.storage import stored

#: A batch of rows -> inputs and targets.
Pairs = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]


def summed(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum over all batches of an array of fixed length; a task sends one array, and the sum of each place is a grouped one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "x": total})

    found = rows.mapInPandas(run, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).toPandas()
    return found.sort_values("place")["x"].to_numpy()


def blocks(rows: DataFrame, pairs: Pairs, width: int) -> DataFrame:
    """Inputs and targets of the rows as a stored table of arrays in bytes; inputs as places and values where that is smaller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for batch in batches for p in dense_parts(batch, width)):
            x, y = pairs(part)
            at = np.flatnonzero(x)
            sparse = at.nbytes + 8 * len(at) < x.nbytes
            yield pd.DataFrame({"n": [len(x)], "places": [at.tobytes() if sparse else None], "x": [(x.ravel()[at] if sparse else x).tobytes()], "y": [y.tobytes()]})

    return stored(rows.mapInPandas(run, "n long, places binary, x binary, y binary"))


def pairs_of(batch: pd.DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets of each block."""
    for n, places, found, targets in batch[["n", "places", "x", "y"]].itertuples(index=False, name=None):
        x = np.frombuffer(found)
        if places is not None:
            x = np.zeros(n * width)
            x[np.frombuffer(places, np.int64)] = np.frombuffer(found)
        yield x.reshape(n, width), np.frombuffer(targets).reshape(n, -1)


def trained(rows: DataFrame, pairs: Pairs, sizes: list[int], max_iter: int, seed: int, alpha: float, tanh: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of least mean squared error over all ``rows``, read once; only the weights and sums of their shape pass through the driver."""
    learned = blocks(rows, pairs, max(sizes))
    n = learned.agg(F.sum("n")).first()[0] or 0
    weight = np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in zip(sizes, sizes[1:])])

    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def of(batch: pd.DataFrame) -> np.ndarray:
            return sum(kernels.network_gradient(x, y, flat, sizes, tanh) for x, y in pairs_of(batch, sizes[0]))

        total = summed(learned, of) / n
        return total[0] + alpha * float((weight * flat * flat).sum()) / 2 / n, total[1:] + alpha * weight * flat / n

    return kernels.network_layers(kernels.limited_memory_descent(evaluate, kernels.network_start(sizes, seed), max_iter), sizes)


def layer_arrays(layers: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Named arrays of a network, to be saved."""
    return {f"{part}{i}": a for i, layer in enumerate(layers) for part, a in zip(("weights", "offsets"), layer)}


def layers_from(arrays: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    n = sum(k.startswith("weights") for k in arrays)
    if not n or any(f"offsets{i}" not in arrays for i in range(n)):
        raise StateError("arrays of a network are missing")
    return [(arrays[f"weights{i}"], arrays[f"offsets{i}"]) for i in range(n)]
