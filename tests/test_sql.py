"""Functions for SQL text."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlens import errors
from cohortlens.operators import projection
from cohortlens.plans import catalogue, sql

SF = "/root/testdata/sf0.001"
WORDS = [(k, g, i, float(w)) for k, row in enumerate([[2, 1, 0], [0, 1, 3]]) for i, (g, w) in enumerate(zip("ABC", row))]


@pytest.fixture
def words(spark):
    return spark.createDataFrame(WORDS, "program_idx int, gene_id string, gene_pos int, weight double")


def test_sql_projection_equals_the_operator(spark):
    one, two = ({(r.sample_id, r.cell_id): r for r in catalogue.registered()[name](spark, SF).collect()} for name in ("sql_nnls", "nnls_all"))
    assert one.keys() == two.keys() and len(one) > 100
    for k, r in one.items():
        assert np.allclose(r.usages, two[k].usages) and np.allclose(r.states, two[k].states) and r.uncertainty is None
        assert np.allclose([r.projection_error, r.relative_error, r.observed_coverage], [two[k].projection_error, two[k].relative_error, two[k].observed_coverage])


def test_sql_scores_equal_the_operator(spark):
    one, two = ({(r.sample_id, r.cell_id, r.program_idx): r.score for r in catalogue.registered()[name](spark, SF).collect()} for name in ("sql_scores", "score_direct"))
    assert one.keys() == two.keys() and one == pytest.approx(two, abs=2e-6)


def test_odd_cells_in_sql(spark, words, monkeypatch):
    rows = [("s", "null", None), ("s", "none", {}), ("s", "x", {"A": 4.0, "B": 2.0, "Z": 9.0}), ("s", "y", {"C": 3.0, "B": 1.0, "A": None}), (None, None, {"B": 1.0}), ("s", "x", {"A": 4.0, "B": 2.0})]
    cells = spark.createDataFrame(rows, "sample_id string, cell_id string, values map<string,double>")
    for elements in (1 << 22, 3):  # all at once, and cell by cell
        monkeypatch.setattr(sql, "ELEMENTS", elements)
        sql.register(spark, words)
        found = spark.sql("SELECT * FROM project_cells(TABLE({c}))", c=cells.repartition(1)).collect()
        got = sorted((str(r.cell_id), [round(u, 9) for u in r.usages]) for r in found)
        basis = np.array([[w[3] for w in WORDS if w[0] == k] for k in range(2)]).T
        third = projection.kernels.nonnegative_quadratics(basis.T @ basis, np.array([[0.0, 1, 0]]) @ basis)[0]
        assert got == sorted([("null", [0, 0]), ("none", [0, 0]), ("x", [2, 0]), ("x", [2, 0]), ("y", [0, 1]), ("None", [round(u, 9) for u in third])])
    assert spark.sql("SELECT * FROM project_cells(TABLE({c}) PARTITION BY sample_id)", c=cells).count() == 6
    assert spark.sql("SELECT * FROM project_cells(TABLE({c}))", c=cells.limit(0)).count() == 0
    sql.register(spark, words, "poisson", "by_poisson", max_iter=50)
    assert spark.sql("SELECT * FROM by_poisson(TABLE({c}))", c=cells).count() == 6


def test_scalars_in_sql(spark, words):
    sql.register(spark, words)
    one = lambda text: spark.sql(f"SELECT {text} AS x").first().x
    assert one("cell_depth(array(1D, NULL, 2D))") == 3 and one("cell_depth(NULL)") == 0
    assert one("cell_detected(array(1D, 0D, NULL))") == 1 and one("cell_detected(NULL)") == 0
    assert one("log1p_values(array(1D, 3D), 8D)") == pytest.approx([np.log1p(2), np.log1p(6)])
    assert one("program_score(array(2, 0, 7), array(5D, 2D, 1D), array(10D, 20D, 30D))") == 170
    assert one("program_score(NULL, NULL, array(1D))") == 0
    assert one("state_shares(array(1D, 3D))") == [0.25, 0.75] and one("state_shares(array(0D, 0D))") == [0, 0]


def test_methods_that_learn_are_refused(spark, words):
    with pytest.raises(errors.ProjectionError, match="learns from all cells"):
        sql.register(spark, words, "neural")
    with pytest.raises(errors.ProjectionError, match="no gene"):
        sql.register(spark, words.limit(0))
