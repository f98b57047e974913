"""What the reviewer of round 3 found: queries on tables whose programs are nearly alike."""

import os
import threading
import tracemalloc
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortlens import errors
from cohortlens.functions import kernels
from cohortlens.operators import factorisation, metrics, network, programs, projection, recurrence, scoring, state
from cohortlens.plans import catalogue, pipeline


def tables_of(folder, regions, quantities):
    """Relational tables of one customer a row: ``quantities`` are customers x brands, 0 for none; each brand is one part."""
    write = lambda name, **columns: pq.write_table(pa.table(columns), os.path.join(folder, f"{name}.parquet"))
    n, n_brands = quantities.shape
    cell, brand = np.nonzero(quantities)
    write("nation", n_nationkey=sorted(set(regions)), n_regionkey=sorted(set(regions)))
    write("customer", c_custkey=np.arange(n), c_nationkey=regions, c_mktsegment=[f"m{i % 2}" for i in range(n)])
    write("part", p_partkey=np.arange(n_brands), p_brand=[f"Brand#{11 + i}" for i in range(n_brands)])
    write("orders", o_orderkey=np.arange(n), o_custkey=np.arange(n))
    write("lineitem", l_orderkey=cell, l_partkey=brand, l_quantity=quantities[cell, brand].astype(float))
    return str(folder)


def both(spark, name, folder):
    """Rows of a query and of its SQL, sorted."""
    db = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = catalogue.registered()[name](spark, folder)
    columns = ", ".join(found.columns)
    return sorted(tuple(r) for r in found.collect()), sorted(db.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())


def test_a_program_whose_top_genes_are_a_whole_bin_is_scored_without_controls(spark, tmp_path):  # F1
    quantities = np.arange(1, 26) + np.random.default_rng(0).integers(0, 2, (12, 25)) / 4  # brands in one order in all cells
    folder = tables_of(tmp_path, [i // 4 for i in range(12)], quantities)
    ours, theirs = both(spark, "score_matched_control", folder)
    assert len(ours) == 24 and ours == theirs and min(r[-1] for r in ours) > 0
    _, logged, words = catalogue._start(spark, folder)
    with pytest.raises(errors.StateError, match="no control genes"):
        scoring.matched_control(logged, words, ["0", "1"], n_top=5, n_bins=5)


@pytest.mark.parametrize("apart", [True, False])
def test_overlap_summary_equals_its_sql_if_pairs_share_nothing(spark, tmp_path, apart):  # F2
    brands = np.eye(2) if apart else np.array([[1, 0], [0, 1], [1, 1]])
    folder = tables_of(tmp_path, [i // 2 for i in range(2 * len(brands))], np.repeat(brands, 2, 0))
    ours, theirs = both(spark, "overlap_summary", folder)
    assert ours == theirs and {r[-1] for r in ours} == ({None} if apart else {1})
    found = catalogue._programs(spark, folder).where("weight > 0")
    assert {r.minimum_pairwise_shared for r in recurrence.overlap_summary(found).collect()} == {0}


def test_fits_in_tasks_take_packed_cells(spark):  # F3 to F6
    logged = catalogue._logged(spark, "/root/testdata/sf0.001")
    plan = programs.fitted_programs(logged, 2, repeats=2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_factorisation_needs_little_beside_its_matrix():  # F3 to F6
    x = np.random.default_rng(0).random((60_000, 25))
    tracemalloc.start()
    kernels.nmf(x, 3, 0, max_iter=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes


@pytest.mark.parametrize("dispersion", [None, 0.1])
def test_mixtures_on_few_genes_run_on_dense_rows(monkeypatch, dispersion):  # F7, F11, F14
    rng = np.random.default_rng(0)
    counts, basis = rng.poisson(2.0, (300, 25)).astype(float), rng.random((25, 5))
    counts[3] = 0
    monkeypatch.setattr(kernels, "NARROW", 0)
    sparse = kernels.mixture_em(counts, basis, 300, 1e-8, dispersion)
    monkeypatch.undo()
    monkeypatch.setattr(kernels.SparseRows, "__matmul__", None)  # no product of sparse rows in a sweep
    assert np.abs(kernels.mixture_em(counts, basis, 300, 1e-8, dispersion) - sparse).max() < 1e-4


def test_noise_is_drawn_from_seeds_in_arrays(monkeypatch):  # F13
    values, basis = np.random.default_rng(0).poisson(2.0, (50, 25)).astype(float), np.random.default_rng(1).random((25, 2))
    linear = []
    for x in values:  # a cell at a time, as a list of words
        rng = np.random.default_rng([5, *np.frombuffer(x.tobytes(), np.uint32)])
        linear.append(np.maximum(x + rng.normal(size=(8, 25)) * 0.05 * np.sqrt(x + 1), 0) @ basis)
    want = kernels.nonnegative_quadratics(basis.T @ basis, np.concatenate(linear)).reshape(50, 8, 2)
    made, kinds = np.random.default_rng, set()
    monkeypatch.setattr(np.random, "default_rng", lambda seed: kinds.add(type(seed)) or made(seed))
    mean, deviation = projection.variational(seed=5)(values, basis)
    assert np.array_equal(mean, want.mean(1)) and np.array_equal(deviation, want.std(1)) and kinds == {np.ndarray}


@pytest.mark.parametrize("k", [3, 8, 70])
def test_rows_are_grouped_by_their_free_variables(k):  # F13
    rng = np.random.default_rng(0)
    free, linear, root = rng.random((40, k)) < 0.5, rng.random((40, k)), rng.random((k + 5, k))
    free[::3] = free[0]
    free[1] = False
    found, _ = kernels._solved_alike(root.T @ root, linear, free, None)
    for own, b, x in zip(free, linear, found):
        assert not x[~own].any() and np.allclose((root.T @ root)[np.ix_(own, own)] @ x[own], b[own])


def test_a_network_makes_its_inputs_once(spark, tmp_path):  # F8, F10
    folder = str(tmp_path)

    def pairs(batch):
        open(os.path.join(folder, f"{batch['id'].min()}-{os.urandom(4).hex()}"), "w").close()
        x = np.array(batch["id"], float)[:, None] % [5, 7] / 10
        return x, x[:, :1]

    network.trained(spark.range(0, 200, numPartitions=2), pairs, [2, 3, 1], 20, 0, 1e-4)
    assert sorted(f.split("-")[0] for f in os.listdir(folder)) == ["0", "100"]


def test_blocks_of_a_network_keep_dense_and_sparse_inputs(spark):  # F8, F10
    rows = spark.range(0, 40, numPartitions=1)
    for zeros in (0.0, 0.9):
        x = np.random.default_rng(0).random((40, 6)) + 1
        x[np.random.default_rng(1).random((40, 6)) < zeros] = 0
        table = network.blocks(rows, lambda b, x=x: (x[b["id"]], x[b["id"], :2]), 6).toPandas()
        ((got, targets),) = network.pairs_of(table, 6)
        assert table["places"].isna().all() == (not zeros) and np.array_equal(got, x) and np.array_equal(targets, x[:, :2])


def test_axes_of_few_genes_take_two_passes(spark, monkeypatch):  # F8
    logged = catalogue._logged(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(state, "NARROW", 0)
    _, wide = state.expression_pca(logged, ["0", "1", "2"], 3)
    monkeypatch.undo()
    passes, summed = [], factorisation.summed_blocks
    monkeypatch.setattr(factorisation, "summed_blocks", lambda *a: passes.append(1) or summed(*a))
    _, narrow = state.expression_pca(logged, ["0", "1", "2"], 3)
    assert len(passes) == 2
    assert np.allclose(narrow.axes, wide.axes, atol=1e-8) and np.allclose(narrow.shares, wide.shares, rtol=1e-9)


def test_scores_are_packed_once_for_all_states(spark, monkeypatch):  # F8
    cohort = catalogue._atlas(spark, "/root/testdata/sf0.001")
    packs, packed = [], state.packed_scores
    monkeypatch.setattr(state, "packed_scores", lambda x: packs.append(1) or packed(x))
    found = pipeline.fit_pipeline(cohort, pipeline.PipelineConfig(("3",), ("4",), min_similarity=-1.0), programs.mean_programs)
    assert len(packs) == 1 and set(found.coordinates) == set(state.METHODS)
    want = {(r.sample_id, r.cell_id): r.x for r in packed(state.standardized(found.scores, ["0", "1", "2"])).collect()}
    assert {(r.sample_id, r.cell_id): r.coordinates for r in found.coordinates["direct"].collect()} == want


def test_tuning_makes_no_reports_that_it_does_not_read(spark, monkeypatch):  # F9
    cohort = catalogue._atlas(spark, "/root/testdata/sf0.001")
    both = [pipeline.PipelineConfig(("3",), ("4",), min_similarity=-1.0, preprocessing=p) for p in pipeline.PREPROCESSING]
    short = [replace(c, state_methods=("direct",)) for c in both]
    want = [pipeline.fit_pipeline(cohort, c, programs.mean_programs).reports["reconstruction"].where("partition = 'validation'").first()["mse"] for c in short]
    monkeypatch.setattr(metrics, "technical_associations", None)
    best, errors = pipeline.tuned(cohort, both, programs.mean_programs)
    assert np.allclose(errors, want, rtol=1e-12) and best == int(np.argmin(want))


def test_lineages_are_fitted_side_by_side_on_their_own_values(spark):  # F12
    logged = catalogue._logged(spark, "/root/testdata/sf0.001")
    first = [r[0] for r in logged.cells.select("lineage").distinct().orderBy("lineage").limit(2).collect()]
    logged, n = logged.kept_cells(logged.cells.where(logged.cells.lineage.isin(first)).select("sample_id", "cell_id")), 2
    every, rows = threading.Barrier(n, timeout=60), []

    def fit(one):
        every.wait()
        ids = one.cells.select("sample_id", "cell_id")
        rows.append((one.cells.count(), one.expr.count(), one.expr.join(ids, ["sample_id", "cell_id"], "left_anti").count()))
        return programs.fitted_programs(one, 2).drop("run")

    recurrence.hierarchical_vocabularies(logged, fit, shared=False, min_similarity=-1.0, n_permutations=0)
    assert len(rows) == n and sum(r[0] for r in rows) == logged.cells.count() and sum(r[1] for r in rows) == logged.expr.count() and not any(r[2] for r in rows)
