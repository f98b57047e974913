"""What the reviewer of round 4 found: fits of samples that no task has to hold, in time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import errors
from cohortlens.operators import factorisation, prep, programs
from cohortlens.plans import catalogue, pipeline
from cohortlens.sources import atlas

ON = ["sample_id", "run", "program_idx", "gene_id"]


@pytest.fixture(scope="module")
def logged(spark):
    return catalogue._logged(spark, "/root/testdata/sf0.001")


def fitted(logged, **options):
    return programs.fitted_programs(logged, 3, 1, 2, programs.Nmf(**options), True, task_elements=0).toPandas().set_index(ON).sort_index()


def test_sweeps_of_a_spread_fit_are_one_job(spark, logged, monkeypatch):  # F1
    want = programs.fitted_programs(logged, 3, 1, 2, programs.Nmf(max_iter=40), True).toPandas().set_index(ON).sort_index()
    monkeypatch.setattr(factorisation, "BLOCK_VALUES", 200)
    monkeypatch.setattr(factorisation.Bucketed, "write", None)  # no table a sweep
    found = fitted(logged, max_iter=40)
    assert (found.index == want.index).all() and (found.sweeps == want.sweeps).all()
    assert np.abs(found.weight - want.weight).max() < 1e-6 and np.allclose(found.error, want.error, rtol=1e-6)


def test_ways_to_sweep_agree(logged, monkeypatch):  # F1
    options = {"max_iter": 60, "tol": 0.05}
    monkeypatch.setattr(factorisation, "BLOCK_VALUES", 200)
    want = fitted(logged, **options)
    ways = {"a temporary file": ("HELD", 0), "groups of samples": ("GATHERED", 8 * 25 * 13 * 2 * 8), "no place for tasks that wait": ("_places", lambda spark: 0), "no shared folder": ("mounted", lambda *a: None), "a folder that tasks can't write to": ("mounted", lambda *a: "/dev/null/x")}
    for way, (name, value) in ways.items():
        with monkeypatch.context() as m:
            m.setattr(factorisation, name, value)
            found = fitted(logged, **options)
        assert (found.index == want.index).all() and (found.sweeps == want.sweeps).all(), way
        assert np.abs(found.weight - want.weight).max() < 1e-9, way


def test_a_spread_fit_of_too_few_cells_raises(spark):  # F1
    cohort = atlas.from_rows(spark, [("a", "c0", "x"), ("a", "c1", "x")], [("a", f"c{i}", g, i + 1) for i in range(2) for g in "pqr"])
    with pytest.raises(errors.ProgramError, match="sample a: 3 programs of 2 cells"):
        programs.fitted_programs(cohort, 3, task_elements=0)


def test_wide_blocks_stay_sparse():  # F1
    rng = np.random.default_rng(0)
    x = rng.poisson(0.05, (50, 400)).astype(float)
    m, w = rng.random((400, 2)), rng.random((50, 2))
    for values, kinds in ((x, {factorisation.SparseRows}), (x + 1, {factorisation.DenseRows})):
        for most in (1 << 20, 0):
            parts = list(factorisation.Space(most).rows(factorisation.SparseRows.of(values), 2))
            assert {type(p) for p in parts} == kinds and sum(len(p) for p in parts) == 50
            assert np.allclose(np.concatenate([p @ m for p in parts]), values @ m)
            ends = np.cumsum([len(p) for p in parts])
            assert np.allclose(sum(p.transposed(w[e - len(p) : e]) for p, e in zip(parts, ends)), values.T @ w)


def test_cells_are_not_counted_if_none_can_fall_out(spark, monkeypatch):  # F1
    cohort = catalogue._atlas(spark, "/root/testdata/sf0.001")
    stray = spark.createDataFrame([("0", "nobody", "Brand#11", 3.0)], "sample_id string, cell_id string, gene_id string, value double")
    cohort = cohort.with_(expr=cohort.expr.unionByName(stray))
    want = prep.filtered_cells(cohort)
    monkeypatch.setattr(prep, "cell_counts", None)
    found = pipeline.prepared(cohort, pipeline.FitOptions(preprocessing="identity"))
    for name in ("cells", "expr"):
        ours, theirs = getattr(found, name), getattr(want, name)
        assert sorted(map(tuple, ours.select(theirs.columns).collect())) == sorted(map(tuple, theirs.collect()))
    assert not found.expr.where(F.col("cell_id") == "nobody").count()
