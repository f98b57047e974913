"""Non-negative factors of samples that no task has to hold: activities stay with their cells, sums are shared.

Cells are packed into blocks of sparse rows, dealt out once. A sweep updates the
activities W of each block by coordinate descent against the weights H (programs
x genes for each sample and restart), adds up W'W and X'W over all blocks, and
updates H from these sums. All samples and restarts of a group advance in the
same sweep, each until it has converged. The start comes from a randomised range
finder whose passes sum genes x (programs + 10) numbers.

All sweeps are one barrier stage: its tasks keep their blocks and activities
(beyond ``HELD`` bytes in a temporary file) and write their sums to the shared
folder; the first task adds them up, updates H and writes it for the others. (A
gathering of Spark's own takes a second, whatever is sent.) A lost executor
costs the sweeps of its group.

Where tasks can't wait for each other (dynamic allocation), the shared folder
isn't one that they can open, or the sums of one sample are too many for one
task (``GATHERED``), a sweep is a pass over tables: blocks are stored in buckets,
each task reads from the table of the sweep before their activities and writes
new ones with its sums, and the driver updates H. Both tables share their
buckets, so nothing of the cells is shuffled again. A lost executor costs its
tasks of one sweep there.

Results equal ``kernels.nmf`` on the whole matrix but for rounding.
"""

from __future__ import annotations

import itertools
import os
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.errors import ProgramError
from cohortlens.functions import kernels
from cohortlens.functions.sparse import DenseRows, SparseRows
from cohortlens.storage import Bucketed, deleted, mounted, shared_dir, stored

#: Values of a block, doubles of a slice of sums, bytes of weights that one pass is sent.
BLOCK_VALUES, SLICE, SENT_BYTES = 1 << 20, 4096, 64 << 20
#: Bytes of sums that a task takes from all others at once, of blocks and activities that it holds in memory.
GATHERED, HELD = 8 << 20, 256 << 20
#: Products of at most so many multiplications, by a matrix and by a vector, are left to one thread by BLAS: each core has a task of its own.
BY_MATRIX, BY_VECTOR = 1 << 18, 9216
BLOCK = "block long, sample_id string, ends array<int>, places binary, found binary"
Key = tuple[str, int]


@dataclass
class Run:
    """One restart of one sample on the driver: its gene axis, weights, and how far it has come."""

    here: np.ndarray
    n_cells: int
    squares: float
    mean: float
    h: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    first: float | None = None
    sweeps: int = 0
    error: float = 0.0
    converged: bool = False


def _rows_of(block: dict, n_genes: int) -> SparseRows:
    ends = np.asarray(block["ends"], np.int64)
    rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return SparseRows(len(ends), n_genes, rows, np.frombuffer(block["places"], np.int32), np.frombuffer(block["found"], np.float64))


def blocks(packed: DataFrame) -> DataFrame:
    """Cells packed one a row (sample_id, places, found) as blocks of sparse rows of one sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for sample, part in batch.groupby("sample_id", sort=False):
                sizes = part["places"].map(lambda p: 0 if p is None else len(p)).to_numpy()
                for _, rows in part.groupby((np.cumsum(sizes) - sizes) // BLOCK_VALUES, sort=False):
                    held = rows.dropna(subset=["places"])
                    ends = np.cumsum(rows["places"].map(lambda p: 0 if p is None else len(p)))
                    places = np.concatenate([np.zeros(0, np.int32), *held["places"]]).astype(np.int32)
                    found = np.concatenate([np.zeros(0), *held["found"]]).astype(np.float64)
                    yield pd.DataFrame({"block": [number], "sample_id": sample, "ends": [ends.astype(np.int32).tolist()], "places": [places.tobytes()], "found": [found.tobytes()]})
                    number += 1

    return packed.select("sample_id", "places", "found").mapInPandas(run, BLOCK)


SUMS = "sample_id string, run int, slice int, data binary"


def _sliced(total: dict[Key, np.ndarray]) -> Iterator[tuple[str, int, int, bytes]]:
    for (sample, run), x in total.items():
        for i in range(0, len(x), SLICE):
            yield sample, run, i // SLICE, x[i : i + SLICE].tobytes()


def _added(rows: DataFrame) -> dict[Key, np.ndarray]:
    """Sums of equal slices over all tasks, put together on the driver: arrays of fixed length, one for each sample and restart."""

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in part["data"])
        return pd.DataFrame([(*key, total.tobytes())], columns=["sample_id", "run", "slice", "data"])

    out: dict[Key, list] = {}
    # at most SENT_BYTES of sums, in one job: those of a local iterator run one after the other
    for r in sorted(rows.groupBy("sample_id", "run", "slice").applyInPandas(add, SUMS).collect(), key=lambda r: (r["sample_id"], r["run"], r["slice"])):
        out.setdefault((r["sample_id"], r["run"]), []).append(np.frombuffer(r["data"], np.float64))
    return {k: np.concatenate(v) for k, v in out.items()}


def summed_blocks(table: DataFrame, runs: dict[str, list[int]], n_genes: int, of: Callable[[SparseRows, str, int], np.ndarray]) -> dict[Key, np.ndarray]:
    """Sum of ``of`` over all blocks by sample and restart; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Key, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = _rows_of(row, n_genes)
                for r in runs[row["sample_id"]]:
                    part = of(x, row["sample_id"], r)
                    key = row["sample_id"], r
                    total[key] = total[key] + part if key in total else part
        rows = list(zip(*_sliced(total)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["sample_id", "run", "slice", "data"])

    return _added(table.mapInArrow(run, SUMS))


def _started(summed: Callable[[Callable], dict[Key, np.ndarray]], agreed: Callable, fits: dict[Key, Run], k: int, n_genes: int, seed: int) -> dict[Key, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets the first weights of each fit; returns what turns values into first activities: map, sign and scale of each program.

    ``summed`` adds up a function of blocks over all of them; of what several tasks decompose, ``agreed`` gives one's result to all.
    """

    def products(sent: dict[Key, np.ndarray]) -> dict[Key, np.ndarray]:
        """X'X times the matrix of each fit."""
        found = summed(lambda x, s, r: x.transposed(x @ sent[s, r]).ravel())
        return {key: v.reshape(n_genes, -1) for key, v in found.items()}

    sketch = {}
    for (sample, run), fit in fits.items():
        width = min(fit.n_cells, len(fit.here), k + 10)
        sketch[sample, run] = np.zeros((n_genes, width))
        sketch[sample, run][fit.here] = np.random.default_rng(seed + run).standard_normal((len(fit.here), width))
    for _ in range(4):
        sketch = agreed({key: np.linalg.qr(v)[0] for key, v in products(sketch).items()})
    image, maps, right, sizes = products(sketch), {}, {}, {}
    for key, v in image.items():
        # q = X t / root has orthonormal columns; q'X = (root^-1)' (X'X t)'
        values, vectors = np.linalg.eigh(sketch[key].T @ v)
        kept = values > 1e-14 * max(values.max(), 1e-300)
        inverse = vectors[:, kept] / np.sqrt(values[kept])
        left, s, vt = np.linalg.svd(inverse.T @ v.T, full_matrices=False)
        short = max(0, k - len(s))
        maps[key] = np.pad((sketch[key] @ inverse @ left)[:, :k], ((0, 0), (0, short)))
        right[key], sizes[key] = np.pad(vt[:k], ((0, short), (0, 0))), np.pad(s[:k], (0, short))
    maps, right, sizes = agreed((maps, right, sizes))

    def halves(x: SparseRows, sample: str, run: int) -> np.ndarray:
        u = x @ maps[sample, run]
        return np.r_[(np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0)]

    out = {}
    for key, v in summed(halves).items():
        fit = fits[key]
        signs, scales, h = kernels.start_halves(np.sqrt(v[:k]), np.sqrt(v[k:]), sizes[key], right[key])
        fit.h = h[:, fit.here]
        fit.h[fit.h < 1e-12] = fit.mean / 100
        out[key] = maps[key], signs, scales
    return out


def _first(x: SparseRows | DenseRows, by: np.ndarray, signs: np.ndarray, scales: np.ndarray, fill: float) -> np.ndarray:
    """First activities of a block."""
    u = x @ by
    w = np.where(signs == 0, abs(u), np.maximum(signs * u, 0)) * scales
    w[w < 1e-12] = fill
    return w


def _half_swept(x: SparseRows | DenseRows, w: np.ndarray, h: np.ndarray, gram: np.ndarray, on_w: float, l1_ratio: float) -> np.ndarray:
    """Updates the activities of a block in place; its sums: how far slopes were from rest, W'W and X'W."""
    moved = kernels.coordinate_sweep(w, gram, x @ h, on_w, l1_ratio)
    return np.concatenate([[moved], (w.T @ w).ravel(), x.transposed(w).ravel()])


def _sent(fit: Run, k: int, n_genes: int, alpha_w: float) -> tuple[np.ndarray, np.ndarray, float]:
    """What a half sweep takes of a fit: its weights on all genes, their products and the penalty on activities."""
    full = np.zeros((n_genes, k))
    full[fit.here] = fit.h.T
    return full, fit.h @ fit.h.T, alpha_w * len(fit.here)


def _swept(cells: Bucketed, before: Bucketed | None, fits: dict[Key, Run], active: dict[str, list[int]], start, penalties: tuple[float, float, float], k: int, n_genes: int) -> Bucketed:
    """A table of new activities (kind ``w``) and of the sums that the driver needs (kind ``s``), from one pass."""
    alpha_w, _, l1_ratio = penalties
    sent = {}
    for sample, runs in active.items():
        for r in runs:
            sent[sample, r] = *_sent(fits[sample, r], k, n_genes, alpha_w), fits[sample, r].mean / 100
    start = {key: v for key, v in (start or {}).items() if key in sent}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Key, np.ndarray] = {}
        last = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sample, last = row["sample_id"], row["block"]
                if not (runs := active.get(sample)):
                    continue
                x, kept = _rows_of(row, n_genes), []
                known = dict(zip(row["runs"], row["data"])) if not start else {}
                for r in runs:
                    h, gram, on_w, fill = sent[sample, r]
                    w = _first(x, *start[sample, r], fill) if start else np.frombuffer(known[r], np.float64).reshape(len(x), k).copy()
                    part = _half_swept(x, w, h, gram, on_w, l1_ratio)
                    total[sample, r] = total[sample, r] + part if (sample, r) in total else part
                    kept.append(w.tobytes())
                out.append(("w", last, sample, runs, kept, 0))
            if out:
                yield _table(out)
        rows = [("s", last, s, [r], [data], i) for s, r, i, data in _sliced(total)]
        if rows:
            yield _table(rows)

    rows = cells.read() if before is None else cells.read().join(before.read().where("kind = 'w'").select("block", "runs", "data").hint("shuffle_hash"), "block")
    return Bucketed.write(rows.mapInArrow(run, "kind string, block long, sample_id string, runs array<int>, data array<binary>, slice int"), cells.n, "block", dealt=True)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["kind", "block", "sample_id", "runs", "data", "slice"])


def _fits(flat: dict[str, np.ndarray], n_genes: int, k: int, repeats: int, own_axis: bool) -> dict[Key, Run]:
    """A fit for each restart of each sample, from the sums of ``_flat``."""
    fits: dict[Key, Run] = {}
    for sample, x in sorted(flat.items()):
        here = np.flatnonzero(x[3:]) if own_axis else np.arange(n_genes)
        if x[0] < 2 or k > min(x[0], len(here)):
            raise ProgramError(f"sample {sample}: {k} programs of {int(x[0])} cells and {len(here)} genes")
        for r in range(repeats):
            fits[sample, r] = Run(here, int(x[0]), x[1], x[2] / (x[0] * len(here)))
    return fits


def _flat(x: SparseRows) -> np.ndarray:
    """Cells, squares, sum, and the number of values of each gene."""
    return np.r_[len(x), (x.found**2).sum(), x.found.sum(), np.bincount(x.places, minlength=x.width)]


def factorised(packed: DataFrame, names: list[str], n_values: int, n_genes: int, k: int, seed: int, repeats: int, max_iter: int, tol: float, alpha_w: float, alpha_h: float, l1_ratio: float, own_axis: bool) -> Iterator[tuple[str, int, np.ndarray, Run]]:
    """(sample, restart, gene places, fit) of the samples ``names`` in ``packed``, in groups of samples; ``n_values`` counts zeros, too."""
    spark: SparkSession = packed.sparkSession
    n_tasks = min(_places(spark), -(-n_values // BLOCK_VALUES))
    sums = 8 * n_genes * (k + 10) * repeats
    options = k, n_genes, seed, repeats, max_iter, tol, (alpha_w, alpha_h, l1_ratio), own_axis
    folder = mounted(spark, shared_dir(spark))
    if n_tasks and folder and sums * n_tasks <= GATHERED:
        group = GATHERED // (sums * n_tasks)
        table = blocks(packed) if group >= len(names) else stored(blocks(packed))
        found = (_in_step(table.where(F.col("sample_id").isin(names[at : at + group])).repartition(n_tasks), folder, *options) for at in range(0, len(names), group))
        if (first := next(found)) is not None:
            yield from itertools.chain(first, *found)
            return
    cells = Bucketed.write(blocks(packed), max(spark.sparkContext.defaultParallelism, -(-n_values // (4 * BLOCK_VALUES))), "block")
    group = max(1, SENT_BYTES // sums)
    for at in range(0, len(names), group):
        yield from _in_passes(cells, names[at : at + group], *options)
    cells.drop()


def _in_passes(cells: Bucketed, chosen: list[str], k: int, n_genes: int, seed: int, repeats: int, max_iter: int, tol: float, penalties: tuple[float, float, float], own_axis: bool) -> Iterator[tuple[str, int, np.ndarray, Run]]:
    """Every sweep is a stored table."""
    table = cells.read().where(F.col("sample_id").isin(chosen))
    fits = _fits({s: x for (s, _), x in summed_blocks(table, {s: [0] for s in chosen}, n_genes, lambda x, s, r: _flat(x)).items()}, n_genes, k, repeats, own_axis)
    active = {s: list(range(repeats)) for s in chosen}
    start = _started(lambda of: summed_blocks(table, active, n_genes, of), lambda x: x, fits, k, n_genes, seed)
    own, before = Bucketed(table, cells.n), None
    while active:
        now = _swept(own, before, fits, active, start, penalties, k, n_genes)
        start = None
        sums = now.read().where("kind = 's'").select("sample_id", F.col("runs")[0].alias("run"), "slice", F.col("data")[0].alias("data"))
        for key, x in _added(sums).items():
            _advance(fits[key], x, k, n_genes, *penalties[1:], max_iter, tol)
        if before is not None:
            before.drop()
        before = now
        active = {s: left for s, runs in active.items() if (left := [r for r in runs if not fits[s, r].converged and fits[s, r].sweeps < max_iter])}
    before.drop()
    yield from ((s, r, fit.here, fit) for (s, r), fit in fits.items())


def _places(spark: SparkSession) -> int:
    """How many tasks run at once, as Spark counts them for a barrier stage; 0 if it has none (dynamic allocation)."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    scala = context._jsc.sc()
    return scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())


class Space:
    """Keeps arrays: in memory up to a number of bytes, beyond that in a temporary file that is paged in."""

    def __init__(self, most: int):
        self.left, self.at, self.file = most, 0, None

    def kept(self, x: np.ndarray) -> np.ndarray:
        if x.nbytes <= self.left or not x.nbytes:
            self.left -= x.nbytes
            return x
        self.file = self.file or tempfile.TemporaryFile()
        self.file.truncate(self.at + x.nbytes)
        out = np.memmap(self.file, x.dtype, "r+", self.at, x.shape, "C" if x.flags.c_contiguous else "F").view(np.ndarray)
        out[...] = x
        self.at += x.nbytes
        return out

    def rows(self, x: SparseRows, k: int) -> Iterator[SparseRows | DenseRows]:
        """A block as it is, or in dense parts if that takes no more bytes."""
        if 8 * len(x) * x.width > x.rows.nbytes + x.places.nbytes + x.found.nbytes:
            yield SparseRows(len(x), x.width, *(self.kept(a) for a in (x.rows, x.places, x.found)))
        else:
            for part in x.dense(x.width * max(1, min(BY_MATRIX // (x.width * k), BY_VECTOR // k))):
                yield DenseRows(self.kept(part))


class Team:
    """The tasks of a barrier stage, of which each calls the same methods in the same order; what they say lies in a folder that all can open."""

    def __init__(self, folder: str):
        self.context = BarrierTaskContext.get()
        self.rank, self.n = self.context.partitionId(), len(self.context.getTaskInfos())
        self.folder, self.step = f"{folder}/{self.context.taskAttemptId()}", 0

    def met(self) -> bool:
        """Whether each can write where the first task does: in a folder of this attempt of the stage."""
        here = "yes"
        try:
            if not self.rank:
                os.makedirs(self.folder)
        except OSError:
            here = ""
        self.folder = self.context.allGather(self.folder)[0]
        try:
            self._write("here", True)
        except OSError:
            here = ""
        return all(self.context.allGather(here))

    def _path(self, what: object, rank: int) -> str:
        return f"{self.folder}/{what}-{rank}"

    def _write(self, what: object, x: Any) -> None:
        path = self._path(what, self.rank)
        with open(f"{path}.part", "wb") as f:
            pickle.dump(x, f, pickle.HIGHEST_PROTOCOL)
        os.replace(f"{path}.part", path)

    def _read(self, what: object, rank: int) -> Any:
        while True:  # Spark ends this task if the other one fails
            try:
                with open(self._path(what, rank), "rb") as f:
                    return pickle.load(f)
            except FileNotFoundError:
                time.sleep(0.001)

    def led(self, x: Any, of: Callable[[list], Any]) -> Any:
        """What the first task makes ``of`` all that the tasks give, in their order."""
        now, last = self.step, self.step - 1
        self.step += 1
        if self.rank:
            self._write(now, x)
            found = self._read(f"made-{now}", 0)
            os.remove(self._path(now, self.rank))
            return found
        found = of([x, *(self._read(now, i) for i in range(1, self.n))])
        self._write(f"made-{now}", found)
        if now:  # all have read it
            os.remove(self._path(f"made-{last}", 0))
        return found


def _together(parts: list[dict]) -> dict:
    """Arrays by key, added up."""
    out: dict = {}
    for part in parts:
        for key, x in part.items():
            out[key] = out[key] + x if key in out else x
    return out


def _in_step(table: DataFrame, folder: str, k: int, n_genes: int, seed: int, repeats: int, max_iter: int, tol: float, penalties: tuple[float, float, float], own_axis: bool) -> list[tuple[str, int, np.ndarray, Run]] | None:
    """All sweeps in one barrier stage, whose tasks are the partitions of ``table``; none if they don't share ``folder``."""
    alpha_w, alpha_h, l1_ratio = penalties
    folder = f"{folder}/team-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, space = Team(folder), Space(HELD)
        own: dict[str, list[SparseRows | DenseRows]] = {}
        flat: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x, sample = _rows_of(row, n_genes), row["sample_id"]
                flat[sample] = flat.get(sample, 0) + _flat(x)
                own.setdefault(sample, []).extend(space.rows(x, k))
        if not team.met():
            return

        def summed(of: Callable) -> dict[Key, np.ndarray]:
            return team.led({(s, r): sum(of(x, s, r) for x in own[s]) for s, r in fits if s in own}, _together)

        def advanced(parts: list[dict]) -> dict[Key, Run]:
            for key, x in _together(parts).items():
                _advance(fits[key], x, k, n_genes, alpha_h, l1_ratio, max_iter, tol)
            return {key: fits[key] for key in active}

        try:
            fits = _fits(team.led(flat, _together), n_genes, k, repeats, own_axis)
        except ProgramError as e:  # in all tasks; the driver raises it
            yield said([("", -1, pickle.dumps(e))] if not team.rank else [])
            return
        start = _started(summed, lambda x: team.led(x, lambda parts: parts[0]), fits, k, n_genes, seed)
        w = {(s, r): [space.kept(np.asfortranarray(_first(x, *start[s, r], fit.mean / 100))) for x in own.get(s, [])] for (s, r), fit in fits.items()}
        active = list(fits)
        while active:
            total, sent = {}, {key: _sent(fits[key], k, n_genes, alpha_w) for key in active}
            for sample, held in own.items():
                runs = [key for key in active if key[0] == sample]
                for i, x in enumerate(held):
                    for key in runs:
                        part = _half_swept(x, w[key][i], *sent[key], l1_ratio)
                        total[key] = total[key] + part if key in total else part
            fits |= team.led(total, advanced)
            active = [key for key in active if not fits[key].converged and fits[key].sweeps < max_iter]
        if not team.rank:
            yield said([(s, r, pickle.dumps(fit)) for (s, r), fit in fits.items()])

    def said(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["sample_id", "run", "fit"])

    try:
        # a barrier stage is tried again if a shuffle follows it
        rows = table.mapInArrow(run, "sample_id string, run int, fit binary", barrier=True).repartition(1)
        found = [(s, r, pickle.loads(x)) for s, r, x in rows.collect()]
    finally:
        deleted(table.sparkSession, folder)
    if found and found[0][1] < 0:
        raise found[0][2]
    return [(s, r, fit.here, fit) for s, r, fit in found] or None


def _advance(fit: Run, x: np.ndarray, k: int, n_genes: int, alpha_h: float, l1_ratio: float, max_iter: int, tol: float) -> None:
    """The second half of a sweep: weights from the sums over cells."""
    gram, cross = x[1 : 1 + k * k].reshape(k, k), x[1 + k * k :].reshape(n_genes, k)[fit.here]
    ht = fit.h.T.copy()
    moved = x[0] + kernels.coordinate_sweep(ht, gram, cross, alpha_h * fit.n_cells, l1_ratio)
    fit.h, fit.sweeps = ht.T, fit.sweeps + 1
    fit.first = moved if fit.first is None else fit.first
    fit.converged = fit.first == 0 or moved / fit.first <= tol
    fit.error = float(np.sqrt(max(fit.squares - 2 * (cross * ht).sum() + (gram * (ht.T @ ht)).sum(), 0.0)))
