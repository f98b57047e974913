"""Operators on programs, samples and cells, against closed forms and metamorphic rules."""

import gzip
import itertools
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens import cli, errors, storage
from cohortlens.functions import kernels
from cohortlens.operators import metrics, network, prep, programs, projection, recurrence, scoring, state
from cohortlens.plans import catalogue, pipeline
from cohortlens.sources import artifacts, atlas, matrix_market, results
from cohortlens.streaming.projection import scored_stream


def cohort_of(spark, matrix, samples, lineages=None, genes=None):
    genes = genes or [f"g{j:02d}" for j in range(matrix.shape[1])]
    cells = [(s, f"c{i}", lineages[i] if lineages else None) for i, s in enumerate(samples)]
    values = [(samples[i], f"c{i}", genes[j], matrix[i, j]) for i, j in zip(*np.nonzero(matrix))]
    return atlas.from_rows(spark, cells, values, genes)


def vocabulary_of(spark, weights, genes=None):
    genes = genes or [f"g{j:02d}" for j in range(weights.shape[1])]
    return spark.createDataFrame([(k, g, j, float(weights[k, j])) for k in range(len(weights)) for j, g in enumerate(genes)], "program_idx int, gene_id string, gene_pos int, weight double")


def table(df):
    return {(r["cell_id"], r["program_idx"]): r["score"] for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(2.0, (18, 6)).astype(float)
    x[3] = 0
    w = rng.random((2, 6))
    w /= w.sum(1, keepdims=True)
    samples = [f"d{i % 3}" for i in range(18)]
    return x, w, samples, cohort_of(spark, x, samples), vocabulary_of(spark, w)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    gain = np.random.default_rng(seed).normal(size=(n, m))
    rows, columns = kernels.assignment(gain)
    k = min(n, m)
    best = max(sum(gain[r, c] for r, c in zip(rs, cs)) for rs in itertools.combinations(range(n), k) for cs in itertools.permutations(range(m), k))
    assert len(set(rows)) == len(set(columns)) == k and gain[rows, columns].sum() == pytest.approx(best)


def test_thresholded_assignment_leaves_weak_rows():
    rows, columns = kernels.thresholded_assignment(np.array([[0.9, 0.8], [0.7, 0.1]]), 0.3)
    assert list(zip(rows, columns)) == [(0, 1), (1, 0)]
    assert list(zip(*kernels.thresholded_assignment(np.array([[0.9, 0.2], [0.85, 0.1]]), 0.3))) == [(0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10**6), st.booleans())
def test_quadratic_meets_its_conditions(k, seed, shares):
    rng = np.random.default_rng(seed)
    basis, x = rng.random((8, k)), rng.normal(size=8)
    gram, linear = basis.T @ basis, basis.T @ x
    h = kernels.nonnegative_quadratic(gram, linear, 1.0 if shares else None)
    slope = linear - gram @ h
    price = slope[h > 1e-9].max() if shares else 0.0
    assert (h >= 0).all() and (not shares or abs(h.sum() - 1) < 1e-8)
    assert (slope - price <= 1e-6).all() and np.abs((slope - price)[h > 1e-9]).max(initial=0) < 1e-6


def test_em_raises_the_likelihood_and_keeps_depth():
    rng = np.random.default_rng(1)
    basis = rng.random((9, 3))
    x = rng.poisson(3, (5, 9)).astype(float)
    scale = basis / basis.sum(0)
    loglik = [float((x * np.log(u @ scale.T)).sum()) for u in (kernels.mixture_em(x, basis, n, 1e-300) for n in (1, 5, 50))]
    assert loglik == sorted(loglik) and np.allclose(kernels.mixture_em(x, basis, 9, 1e-9).sum(1), x.sum(1))
    one = np.vstack([kernels.mixture_em(r[None], basis, 200, 1e-8, 0.1) for r in x])
    assert np.allclose(one, kernels.mixture_em(x, basis, 200, 1e-8, 0.1))  # a cell's result doesn't depend on its batch


def test_nmf_recovers_planted_blocks():
    rng = np.random.default_rng(2)
    blocks = np.kron(np.eye(3), np.ones(4))
    x = rng.gamma(2, 1, (60, 3)) @ blocks + 0.01
    w, h, n = kernels.nmf(x, 3, 0)
    assert (w >= 0).all() and (h >= 0).all() and n <= 500
    assert np.linalg.norm(x - w @ h) < 0.02 * np.linalg.norm(x)
    similarity = kernels.rank_similarity(blocks, h)
    assert similarity[kernels.assignment(similarity)].min() > 0.8


def test_average_ranks():
    assert kernels.average_ranks(np.array([[3.0, 1, 3, 2]])).tolist() == [[3.5, 1, 3.5, 2]]


def test_scorers_match_matrices(spark, small):
    x, w, samples, cohort, words = small
    train = np.array([s != "d2" for s in samples])
    assert all(table(scoring.direct(cohort, words))[f"c{i}", k] == pytest.approx((x @ w.T)[i, k]) for i in range(18) for k in range(2))
    mean, sd = x[train].mean(0), x[train].std(0)
    want = ((x - mean) / sd) @ w.T
    got = table(scoring.gene_standardized(cohort, words, ["d0", "d1"]))
    assert all(got[f"c{i}", k] == pytest.approx(want[i, k]) for i in range(18) for k in range(2))
    rate = (x[train].sum(0) + 1e-8) / (x[train].sum(0) + 1e-8).sum()
    depth = x.sum(1, keepdims=True)
    want = np.where(depth > 0, (x - depth * rate) / np.sqrt(np.maximum(depth * rate, 1e-300)), 0) @ w.T
    got = table(scoring.count_residual(cohort, words, ["d0", "d1"]))
    assert all(got[f"c{i}", k] == pytest.approx(want[i, k]) for i in range(18) for k in range(2))
    design = np.c_[np.ones(18), np.log1p(x.sum(1)), np.log1p((x > 0).sum(1))]
    want = (np.log1p(x) - design @ np.linalg.lstsq(design[train], np.log1p(x)[train], rcond=None)[0]) @ w.T
    got = table(scoring.technical_residual(cohort, words, ["d0", "d1"]))
    assert all(got[f"c{i}", k] == pytest.approx(want[i, k]) for i in range(18) for k in range(2))


def test_held_out_values_do_not_leak(spark, small):
    x, w, samples, cohort, words = small
    held = F.col("sample_id") == "d2"
    loud = cohort.with_(expr=cohort.expr.withColumn("value", F.when(held, 1e6).otherwise(F.col("value"))))
    for score in (scoring.gene_standardized, scoring.count_residual, scoring.technical_residual):
        a, b = (table(score(c, words, ["d0", "d1"]).where(~held)) for c in (cohort, loud))
        assert a == pytest.approx(b)
    genes = [sorted(r["gene_id"] for r in prep.selected_genes(c, ["d0", "d1"], n_top=3).collect()) for c in (cohort, loud)]
    assert genes[0] == genes[1]


def test_prep(spark, small):
    x, _, samples, cohort, _ = small
    kept = prep.filtered_cells(cohort, 5, 2, 3)
    want = {f"c{i}" for s in ("d0", "d1", "d2") for i in [i for i in range(18) if samples[i] == s and x[i].sum() >= 5 and (x[i] > 0).sum() >= 2][:3]}
    assert {r["cell_id"] for r in kept.cells.collect()} == want
    moments = {r["gene_id"]: r for r in prep.gene_moments(cohort).collect()}
    assert all(moments[f"g{j:02d}"]["variance"] == pytest.approx(x[:, j].var()) for j in range(6))
    named = cohort_of(spark, x, samples, genes=["MT-1", "rpsA", "B", "C", "D", "E"])
    assert [r["gene_id"] for r in prep.selected_genes(named, prefixes=["mt-", "RPS", "RPL"], exclude=["c"]).orderBy("gene_pos").collect()] == ["B", "D", "E"]
    ties = cohort_of(spark, np.ones((4, 3)), ["a", "a", "b", "b"])
    assert sorted(r["gene_id"] for r in prep.selected_genes(ties, n_top=2).collect()) == ["g01", "g02"]
    logged = prep.library_size_log1p(cohort).expr.where("cell_id = 'c0'").collect()
    assert all(r["value"] == pytest.approx(np.log1p(x[0, int(r["gene_id"][1:])] * 1e4 / x[0].sum())) for r in logged)


def test_input_errors(spark, small):
    x, _, samples, cohort, words = small
    with pytest.raises(errors.InputError, match="negative"):
        prep.validated(cohort.with_(expr=cohort.expr.withColumn("value", -F.col("value"))))
    with pytest.raises(errors.InputError, match="4 samples"):
        prep.validated(cohort, 4)
    with pytest.raises(errors.InputError, match="finite"):
        prep.validated(cohort.with_(expr=cohort.expr.withColumn("value", F.lit(float("nan")))))
    with pytest.raises(errors.StateError, match="unknown samples"):
        prep.sample_split(cohort, ["zz"])
    with pytest.raises(errors.StateError, match="left to train"):
        prep.sample_split(cohort, ["d0", "d1"], ["d2"])
    with pytest.raises(errors.StateError, match="missing"):
        scoring.direct(cohort.kept_genes(cohort.genes.where("gene_pos > 0")), words)
    with pytest.raises(errors.APIError):
        prep.single_sample(cohort)
    with pytest.raises(errors.ProjectionError):
        projection.project(cohort, words, "nnls")  # c3 is empty
    with pytest.raises(errors.ProjectionError):
        projection.regularized_nnls()


@pytest.mark.parametrize("method", projection.available_projectors())
def test_projectors(spark, small, method):
    x, w, _, cohort, words = small
    options = {"l2": 0.1} if method == "regularized_nnls" else {}
    rows = {r["cell_id"]: r for r in projection.project(cohort, words, method, allow_empty=True, **options).collect()}
    dealt = cohort.with_(expr=cohort.expr.repartition(7), cells=cohort.cells.repartition(5))
    again = {r["cell_id"]: r for r in projection.project(dealt, words, method, allow_empty=True, **options).collect()}
    assert len(rows) == 18
    for i in range(18):
        r = rows[f"c{i}"]
        u = np.array(r["usages"])
        assert (u >= 0).all() and (u.sum() == 0 or sum(r["states"]) == pytest.approx(1))
        assert r["projection_error"] == pytest.approx(np.linalg.norm(x[i] - u @ w), abs=1e-6)
        assert np.allclose(u, again[f"c{i}"]["usages"], rtol=1e-5, atol=1e-7)
        assert (r["uncertainty"] is not None) == (method == "variational")


def test_findings_of_a_projection(spark, small):
    x, w, samples, cohort, words = small
    states = projection.project(cohort, words, "nnls", allow_empty=True)
    rows = {r["sample_id"]: r for r in projection.findings(cohort, words, states, 0.2).collect()}
    each = states.toPandas()
    for sample, own in each.groupby("sample_id"):
        r = rows[sample]
        high, unused = int((own["relative_error"] > 0.2).sum()), sum(not any(u > 0 for u in us) for us in own["usages"])
        assert (r["n_cells"], r["n_missing"], r["n_extra"], r["n_high_error"], r["n_unused"]) == (len(own), 0, 0, high, unused)
        assert r["warnings"] == [f"{n} {text}" for n, text in ((high, "cells have a relative error above 0.2"), (unused, "cells use no program")) if n]
    assert sum(r["n_unused"] for r in rows.values()) and len(rows) == each["sample_id"].nunique()
    fewer = cohort.kept_genes(cohort.genes.where("gene_pos > 0"))
    for r in projection.findings(fewer, words, projection.project(fewer, words, "nnls", allow_empty=True)).collect():
        assert r["n_missing"] == 1 and r["warnings"][0] == "1 genes of the vocabulary are missing" and r["n_high_error"] == 0
    assert projection.findings(cohort, words, states.limit(0)).count() == 0
    for threshold in (0, -1.0, float("inf"), float("nan")):
        with pytest.raises(errors.ProjectionError, match="threshold"):
            projection.findings(cohort, words, states, threshold)


def test_registered_findings(spark):
    sf = "/root/testdata/sf0.001"
    each = catalogue.nnls_all(spark, sf).toPandas()
    want = {s: (len(o), 0, int((o["relative_error"] > 0.5).sum())) for s, o in each.groupby("sample_id")}
    found = catalogue.projection_findings(spark, sf).collect()
    assert {r["sample_id"]: (r["n_cells"], r["n_missing"], r["n_high_error"]) for r in found} == want


def test_values_need_a_row_a_cell(spark, tmp_path, small):
    *_, cohort, words = small
    values = cohort.cells.select("sample_id", "cell_id", F.array(F.lit(1.0), F.lit(2.0)).alias("activities"))
    artifacts.save_values(values, str(tmp_path / "whole"), "activities", cells=cohort.cells)
    assert artifacts.load(spark, str(tmp_path / "whole"), "activities")[0]["values"].count() == 18
    one = F.col("cell_id") == "c1"
    strange = values.where(one).withColumn("cell_id", F.lit("zz"))
    for bad, text in ((values.where(~one), "has 0 for 1"), (values.unionByName(values.where(one)), "has 2 for 1"), (values.unionByName(strange), "has 1 for 0")):
        with pytest.raises(errors.StateError, match=text):
            artifacts.save_values(bad, str(tmp_path / "bad"), "activities", cells=cohort.cells)
    uneven = values.withColumn("activities", F.when(one, F.array(F.lit(1.0))).otherwise(F.col("activities")))
    with pytest.raises(errors.StateError, match="1 to 2 values"):
        artifacts.save_values(uneven, str(tmp_path / "bad"), "activities", cells=cohort.cells)
    assert not (tmp_path / "bad").exists()


def test_poisson_needs_counts(spark, small):
    *_, cohort, words = small
    with pytest.raises(Exception, match="whole numbers"):
        projection.project(cohort.with_(expr=cohort.expr.withColumn("value", F.col("value") + 0.5)), words, "poisson", allow_empty=True).collect()


def planted(spark, seed=0, samples=4):
    rng = np.random.default_rng(seed)
    base = np.abs(np.kron(np.eye(3), np.ones(3)) + rng.random((3, 9)) * 0.05)
    rows = []
    for s in range(samples):
        private = rng.random(9)
        w = np.vstack([base[rng.permutation(3)] + np.abs(rng.normal(0, 0.01, (3, 9))), private])
        w /= w.sum(1, keepdims=True)
        rows += [(f"s{s}", k, f"g{j}", j, float(w[k, j])) for k in range(4) for j in range(9)]
    return spark.createDataFrame(rows, "sample_id string, program_idx int, gene_id string, gene_pos int, weight double"), base


def test_recurrence_finds_planted_programs(spark):
    found, base = planted(spark)
    words, members = recurrence.recurrent_vocabulary(found, min_samples=4, min_similarity=0.8, n_permutations=50)
    w = words.toPandas().pivot(index="program_idx", columns="gene_pos", values="weight").to_numpy()
    assert w.shape == (3, 9) and np.allclose(w.sum(1), 1)
    similarity = kernels.rank_similarity(base, w)
    assert similarity[kernels.assignment(similarity)].min() > 0.7
    assert members.count() == 12 and recurrence.build_vocabulary(recurrence.compute_recurrence(found, 0.8, 0), 4, max_redundancy=-1.0)[0].select("program_idx").distinct().count() == 1
    turned = found.withColumn("sample_id", F.concat(F.lit("x"), "sample_id"))
    again, _ = recurrence.recurrent_vocabulary(turned.repartition(5), 4, 0.8, 50)
    assert np.allclose(w, again.toPandas().pivot(index="program_idx", columns="gene_pos", values="weight").to_numpy())
    alone = found.withColumn("gene_id", F.when(F.col("sample_id") == "s0", F.concat("gene_id", F.lit("x"))).otherwise(F.col("gene_id")))
    with pytest.raises(errors.RecurrenceError):
        recurrence.compute_recurrence(alone)
    with pytest.raises(errors.RecurrenceError, match="no program"):
        recurrence.recurrent_vocabulary(found, 4, 1.5, 0)


def test_null_scores_are_seeded(spark):
    found, _ = planted(spark, 3, 3)
    a, b = (recurrence.matched(recurrence.similarity_pairs(found), 30, 7).orderBy("ref_sample", "query_sample").collect() for _ in range(2))
    assert all(np.allclose(r["null_scores"], s["null_scores"]) and len(r["null_scores"]) == 30 and 0 < r["p_value"] <= 1 for r, s in zip(a, b))


def blocks(spark):
    rng = np.random.default_rng(5)
    base = np.kron(np.eye(2), np.ones(5)) + 0.05
    samples = [f"d{i // 20}" for i in range(60)]
    x = np.vstack([rng.poisson(rng.gamma(2, 4, (20, 2)) @ base) for _ in range(3)]).astype(float)
    return cohort_of(spark, x, samples, [("L1", "L2")[i % 2] for i in range(60)])


def test_fit_atlas_never_pools(spark):
    cohort = blocks(spark)
    options = pipeline.FitOptions(n_programs=2, n_repeats=2)
    whole = pipeline.fit_atlas(cohort, options, n_permutations=20)
    assert whole["vocabulary"].select("program_idx").distinct().count() == 2
    one = pipeline.fit(cohort.kept_samples(["d1"]), options)["programs"]
    a = {(r["program_idx"], r["gene_id"]): r["weight"] for r in whole["programs"].where("sample_id = 'd1'").collect()}
    assert a == pytest.approx({(r["program_idx"], r["gene_id"]): r["weight"] for r in one.collect()})
    assert whole["stability"].where("run = 1 and retained").count() == 6 and whole["usages"].count() > 0
    with pytest.raises(errors.APIError):
        pipeline.fit_atlas(cohort, options, min_samples=9)
    with pytest.raises(Exception, match="99 programs"):
        programs.fitted_programs(cohort, 99).collect()


def test_pipeline_and_tuning(spark):
    cohort = blocks(spark)
    config = pipeline.PipelineConfig(validation=("d2",), n_programs=2, n_permutations=10, min_similarity=0.0)
    done = pipeline.fit_pipeline(cohort, config)
    assert {r["partition"] for r in done.reports["reconstruction"].collect()} == {"train", "validation"}
    best, found = pipeline.tuned(cohort, [config, config])
    assert best == 0 and found[0] == found[1]
    with pytest.raises(errors.PipelineError):
        pipeline.fit_pipeline(cohort, pipeline.PipelineConfig(validation=("d1", "d2")))
    with pytest.raises(errors.PipelineError):
        pipeline.PipelineConfig(state_methods=("other",))


def test_hierarchy(spark):
    cohort = blocks(spark)
    found, shared = recurrence.hierarchical_vocabularies(cohort, lambda c: programs.fitted_programs(c, 2).drop("run"), min_similarity=0.0, n_permutations=5)
    assert set(found) == {"L1", "L2"} and shared is not None
    with pytest.raises(errors.HierarchyError):
        recurrence.hierarchical_vocabularies(cohort, None, min_samples=9)


def test_states_and_reports(spark, small):
    x, w, samples, cohort, words = small
    train = np.array([s != "d2" for s in samples])
    scores = scoring.direct(cohort, words)
    raw = x @ w.T
    z = (raw - raw[train].mean(0)) / raw[train].std(0)
    got = table(state.standardized(scores, ["d0", "d1"]))
    assert all(got[f"c{i}", k] == pytest.approx(z[i, k]) for i in range(18) for k in range(2))
    by = state.scaler(scores, ["d0", "d1"])
    back = table(state.unstandardized(state.standardized(scores, ["d0", "d1"], by), by))
    assert all(back[f"c{i}", k] == pytest.approx(raw[i, k]) for i in range(18) for k in range(2))
    coordinates, model = state.linear_state(scores, ["d0", "d1"], 2)
    assert model.shares.sum() == pytest.approx(1) and coordinates.count() == 18
    turned = np.linalg.svd(z[train], full_matrices=False)[2]
    for r in coordinates.collect():
        assert np.allclose(np.abs(r["coordinates"]), np.abs(z[int(r["cell_id"][1:])] @ turned.T), atol=1e-8)
    for r in state.inverse(coordinates, model).collect():
        assert np.allclose(r["x"], raw[int(r["cell_id"][1:])])
    flat, _ = state.expression_pca(cohort, ["d0", "d1"], 2)
    centred = x - x[train].mean(0)
    axes = np.linalg.svd(centred[train], full_matrices=False)[2][:2]
    for r in flat.collect():
        assert np.allclose(np.abs(r["coordinates"]), np.abs(centred[int(r["cell_id"][1:])] @ axes.T), atol=1e-6)
    bent, model = state.nonlinear_state(scores, ["d0", "d1"], 1, 60)
    assert bent.count() == 18 and all(abs(r["coordinates"][0]) <= 1 for r in bent.collect())
    given = np.array([r["x"] for r in state.inverse(bent, model).orderBy(F.substring("cell_id", 2, 9).cast("int")).collect()])
    shrunk = ((raw - given)[train] ** 2).sum() / ((raw - raw[train].mean(0))[train] ** 2).sum()
    assert shrunk < 0.8
    for method in state.METHODS:
        done = state.fitted(method, scores, cohort, ["d0", "d1"], 1)
        for r in done.reconstruction(prep.sample_split(cohort, ["d2"])).collect():
            assert r["n_cells"] == (train if r["partition"] == "train" else ~train).sum() and r["r2"] <= 1 + 1e-9
            assert method != "direct" or r["mse"] == 0
    split = prep.sample_split(cohort, ["d2"])
    for r in metrics.reconstruction(cohort, scores, words, split).collect():
        m = train if r["partition"] == "train" else ~train
        rest = ((x[m] - (raw @ w)[m]) ** 2).sum()
        assert r["mse"] == pytest.approx(rest / x[m].size) and r["r2"] == pytest.approx(1 - rest / ((x[m] - x[m].mean(0)) ** 2).sum())
    boot = metrics.sample_bootstrap(scores, "score", 200)
    assert boot["low"] <= boot["estimate"] <= boot["high"] and boot["n_samples"] == 3
    constant = scores.withColumn("score", F.lit(1.0))
    assert all(np.isnan(r["rho"]) for r in metrics.technical_associations(constant, metrics.covariate_depth(cohort)).collect())


def test_promotion(spark):
    names = [g.replace(" ", "_").replace("-", "_") for g in pipeline.GATES]
    rows = [[True] * 8, [False] + [True] * 7, [True] * 7 + [False]]
    found = pipeline.promotion(spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names))).collect()
    assert [r["decision"] for r in found] == ["promote", "insufficient_evidence", "retain_candidate"] and found[2]["reasons"] == "post-fit interpretation"
    with pytest.raises(errors.ValidationError):
        pipeline.promotion(spark.range(1))


def write_triple(folder, prefix, genes, barcodes, entries, zipped):
    def put(name, text):
        with gzip.open(f"{folder}/{name}.gz", "wt") if zipped else open(f"{folder}/{name}", "w") as f:
            f.write(text)

    put(f"{prefix}{'features' if zipped else 'genes'}.tsv", "".join(f"{g}\tsym{g}\n" for g in genes))
    put(f"{prefix}barcodes.tsv", "".join(f"{b}\n" for b in barcodes))
    body = "".join(f"{g} {c} {v}\n" for g, c, v in entries)
    put(f"{prefix}matrix.mtx", f"%%MatrixMarket matrix coordinate integer general\n%\n{len(genes)} {len(barcodes)} {len(entries)}\n{body}")


def test_matrix_market(spark, tmp_path):
    write_triple(tmp_path, "GSM12_a_", ["A", "B", "C"], ["x", "y"], [(1, 1, 3), (3, 2, 5), (2, 2, 0)], True)
    write_triple(tmp_path, "GSM34_b_", ["C", "A"], ["x"], [(1, 1, 2)], True)
    cohort = matrix_market.read_10x_samples(spark, str(tmp_path))
    assert [r["gene_id"] for r in cohort.genes.orderBy("gene_pos").collect()] == ["A", "C"]
    assert {(r["sample_id"], r["cell_id"], r["gene_id"], r["value"]) for r in cohort.expr.collect()} == {("GSM12", "GSM12:x", "A", 3.0), ("GSM12", "GSM12:y", "C", 5.0), ("GSM34", "GSM34:x", "C", 2.0)}
    with pytest.raises(errors.DatasetError):
        matrix_market.read_10x_samples(spark, str(tmp_path), ["nope"])
    assert {r["gene_symbol"] for r in cohort.genes.collect()} == {"symA", "symC"}
    with tarfile.open(tmp_path / "all.tar", "w") as archive:
        for f in sorted(tmp_path.glob("GSM*.gz")):
            archive.add(f, f"inner/{f.name}")
    packed = matrix_market.read_10x_samples(spark, str(tmp_path / "all.tar"))
    assert sorted(map(tuple, packed.expr.collect())) == sorted(map(tuple, cohort.expr.collect()))
    checked = matrix_market.read_10x_samples(spark, str(tmp_path), min_counts=3)
    assert {r["cell_id"] for r in checked.cells.collect()} == {"GSM12:x", "GSM12:y"}
    assert matrix_market.read_10x_samples(spark, str(tmp_path), max_cells_per_sample=1).cells.count() == 2
    write_triple(tmp_path, "GSM12_c_", ["A"], ["x"], [(1, 1, 2)], True)
    with pytest.raises(errors.DatasetError, match="GSM12"):
        matrix_market.read_10x_samples(spark, str(tmp_path))
    plain = tmp_path / "plain"
    plain.mkdir()
    write_triple(plain, "", ["A"], ["x"], [(1, 1, 7)], False)
    assert matrix_market.read_10x_samples(spark, str(plain)).expr.first()["value"] == 7.0


def test_artifacts_and_command_line(spark, tmp_path):
    cohort = blocks(spark)
    source, fitted, states = (str(tmp_path / n) for n in ("cohort", "fitted", "states"))
    artifacts.save({"cells": cohort.cells, "genes": cohort.genes, "expr": cohort.expr}, source, "cohort")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        artifacts.save({"cells": cohort.cells}, source, "cohort")
    with pytest.raises(errors.InputError):
        artifacts.load(spark, source, "vocabulary")
    fit = ["--n-programs", "2", "--n-repeats", "2", "--preprocessing", "identity"]
    assert cli.main(["fit", "--input", source, "--output", fitted, "--n-permutations", "5", *fit], spark) == 0
    tables, parameters = results.load(spark, f"{fitted}/samples")
    assert {"programs", "stability", "usages", "diagnostics"} == set(tables) and parameters["method"] == "cnmf"
    assert tables["diagnostics"].where("converged and n_iter > 0").count() == 6 and tables["usages"].count() == 2 * cohort.cells.count()
    assert cli.main(["compare", "--input", source, "--vocabulary", f"{fitted}/vocabulary", "--output", states, "--methods", "nnls,regularized_nnls,poisson"], spark) == 0
    shown = spark.read.option("header", True).option("sep", "\t").csv(f"{states}/benchmark.tsv")
    assert shown.count() == 9 and shown.columns[:2] == ["method", "sample_id"]
    for method in ("regularized_nnls", "direct"):
        assert cli.main(["project", "--input", source, "--vocabulary", f"{fitted}/vocabulary", "--output", str(tmp_path / method), "--method", method], spark) == 0
    with pytest.raises(errors.APIError, match="fitted after identity"):
        cli.main(["project", "--input", source, "--vocabulary", f"{fitted}/vocabulary", "--output", str(tmp_path / "x"), "--preprocessing", "library_size_log1p"], spark)
    with pytest.raises(SystemExit):
        cli.main(["compare", "--input", source, "--vocabulary", fitted, "--output", states, "--methods", "nnls,,nnls"], spark)


def test_samples_fitted_apart_aggregate_like_an_atlas(spark, tmp_path):
    cohort = blocks(spark)
    fit = ["--n-programs", "2", "--n-repeats", "2", "--preprocessing", "identity"]
    samples = [r[0] for r in cohort.cells.select("sample_id").distinct().collect()]
    for s in samples:
        cli.save_cohort(cohort.kept_samples([s]), str(tmp_path / f"in-{s}"))
        assert cli.main(["fit", "--input", str(tmp_path / f"in-{s}"), "--sample-id", s, "--output", str(tmp_path / "apart"), *fit], spark) == 0
    cli.save_cohort(cohort, str(tmp_path / "in"))
    rest = ["--min-similarity", "0.0", "--n-permutations", "5"]
    assert cli.main(["aggregate", "--input", str(tmp_path / "apart"), "--output", str(tmp_path / "one"), *rest], spark) == 0
    assert cli.main(["fit", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "two"), *fit, *rest], spark) == 0
    one, two = (sorted(tuple(r) for r in artifacts.load(spark, f"{tmp_path}/{k}/vocabulary", "vocabulary")[0]["vocabulary"].collect()) for k in ("one", "two"))
    assert one and [r[:3] for r in one] == [r[:3] for r in two] and np.allclose([r[3] for r in one], [r[3] for r in two])
    whole = pipeline.fit_samples({s: cohort.kept_samples([s]) for s in samples}, pipeline.FitOptions(2, 2, preprocessing="identity"), 2, min_similarity=0.0, n_permutations=5)
    assert np.allclose(sorted(r["weight"] for r in whole["vocabulary"].collect()), sorted(r[3] for r in one))
    other = ["--n-programs", "2", "--n-repeats", "1", "--preprocessing", "identity"]
    assert cli.main(["fit", "--input", str(tmp_path / f"in-{samples[0]}"), "--sample-id", "other", "--output", str(tmp_path / "apart"), *other], spark) == 0
    with pytest.raises(errors.APIError, match="n_repeats"):
        cli.main(["aggregate", "--input", str(tmp_path / "apart"), "--output", str(tmp_path / "three")], spark)


def test_models_and_evidence_are_restored(spark, tmp_path, small):
    x, w, samples, cohort, words = small
    scores = scoring.direct(cohort, words)
    for kind, (found, model) in {"linear": state.linear_state(scores, ["d0", "d1"], 1), "nonlinear": state.nonlinear_state(scores, ["d0", "d1"], 1, 20)}.items():
        artifacts.save_model(spark, state.model_arrays(model), str(tmp_path / kind), kind)
        again = state.model_from(artifacts.load_model(spark, str(tmp_path / kind), kind))
        raw = x @ w.T
        assert np.allclose(again.coordinates(raw), model.coordinates(raw)) and np.allclose(again.inverse(raw[:, :1]), model.inverse(raw[:, :1]))
        artifacts.save_values(found, str(tmp_path / f"{kind}-values"), "coordinates", {"method": kind})
    with pytest.raises(errors.StateError):
        artifacts.save_values(found.withColumn("coordinates", F.array(F.lit(float("nan")))), str(tmp_path / "bad"), "coordinates")
    ready, genes, basis = projection._prepared(cohort, words, True)
    layers = projection.neural_training(ready, len(genes), basis, max_iter=20)
    artifacts.save_model(spark, network.layer_arrays(layers), str(tmp_path / "net"), "neural")
    kept = network.layers_from(artifacts.load_model(spark, str(tmp_path / "net"), "neural"))
    one, two = (projection.project(cohort, words, "neural", True, layers=n).orderBy("cell_id").toPandas()["usages"].tolist() for n in (layers, kept))
    assert np.allclose(one, two)
    found = programs.fitted_programs(blocks(spark), 2).drop("run", "sweeps", "error")
    seen = recurrence.compute_recurrence(found, 0.0, 5)
    artifacts.save(recurrence.evidence(seen), str(tmp_path / "seen"), "recurrence", {"reference": seen.reference})
    tables, parameters = artifacts.load(spark, str(tmp_path / "seen"), "recurrence")
    built = recurrence.build_vocabulary(recurrence.restored(tables, parameters["reference"]))
    assert sorted(map(tuple, built[0].collect())) == sorted(map(tuple, recurrence.build_vocabulary(seen)[0].collect()))


def test_penalties_shrink_programs():
    x = np.random.default_rng(0).gamma(2, 1, (30, 8))
    plain, penalised = kernels.nmf(x, 3, 0), kernels.nmf(x, 3, 0, alpha_w=0.05, alpha_h=0.05, l1_ratio=0.5)
    assert penalised[0].sum() * penalised[1].sum() < plain[0].sum() * plain[1].sum()
    weights, sweeps, error = programs.nmf_estimator(2)(x, 3, 0)
    assert sweeps == -2 and 0 < error < np.linalg.norm(x) and weights.shape == (3, 8)


def test_run_command(spark, tmp_path):
    rng = np.random.default_rng(2)
    genes = ["MT-G0", "G1", "G2", "RPS3", "G4", "G5", "G6", "G7"]
    cells = [(s, f"{s}{i}", None) for s in ("a", "b", "c", "held") for i in range(6)]
    cohort = atlas.from_rows(spark, cells, [(s, c, g, int(v)) for s, c, _ in cells for g, v in zip(genes, rng.integers(1, 30, len(genes)))], genes)
    cli.save_cohort(cohort.with_(layers={"counts": cohort.expr}), str(tmp_path / "in"))
    run = ["run", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--test-samples", "held", "--n-programs", "2", "--n-permutations", "5", "--min-similarity", "-1", "--remove-mitochondrial", "--remove-ribosomal", "--exclude-genes", "g7", "--n-top-genes", "4", "--state-components", "1", "--layer", "counts"]
    assert cli.main(run, spark) == 0
    tables, parameters = artifacts.load(spark, f"{tmp_path}/out/candidate", "vocabulary")
    kept = {r[0] for r in tables["vocabulary"].select("gene_id").distinct().collect()}
    assert len(kept) == 4 and kept <= {"G1", "G2", "G4", "G5", "G6"} and parameters["validated"] is False
    assert {"coordinates_direct", "coordinates_linear", "coordinates_pca"} <= set(tables) and tables["activities"].count() == 48
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/linear_bootstrap.csv").collect()
    assert len(rows) == 1 and float(rows[0]["low"]) <= float(rows[0]["estimate"]) <= float(rows[0]["high"])


def test_layers_and_symbols(spark):
    cohort = atlas.from_rows(spark, [("a", "x", None), ("b", "y", None)], [("a", "x", "e1", 2), ("b", "y", "e2", 3)])
    named = cohort.with_(genes=cohort.genes.withColumn("gene_symbol", F.when(F.col("gene_id") == "e1", "mt-Nd1")))
    assert [r["gene_id"] for r in prep.selected_genes(named, prefixes=["MT-"]).collect()] == ["e2"]
    layered = cohort.with_(layers={"twice": cohort.expr.withColumn("value", F.col("value") * 2)})
    assert sorted(r["value"] for r in layered.kept_samples(["b"]).matrix("twice").expr.collect()) == [6.0]
    with pytest.raises(errors.InputError):
        cohort.matrix("none")
    with pytest.raises(errors.SampleError):
        cohort.known_samples(["a", "z"])


def test_networks_learn_from_all_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = np.tanh(x @ rng.normal(size=(3, 2)))
    rows = storage.stored(spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(5))
    pairs = lambda b: (np.array(b["x"].tolist()), np.array(b["y"].tolist()))
    flat, sizes, step = kernels.network_start([3, 4, 2], 1), [3, 4, 2], 1e-6
    slope = kernels.network_gradient(x, y, flat, sizes, True)
    for i in (0, 7, 13, 20):
        moved = flat.copy()
        moved[i] += step
        assert (kernels.network_gradient(x, y, moved, sizes, True)[0] - slope[0]) / step == pytest.approx(slope[1 + i], rel=1e-3, abs=1e-3)
    assert np.allclose(network.summed(rows, lambda b: kernels.network_gradient(*pairs(b), flat, sizes, True)), slope)
    layers = network.trained(rows, pairs, sizes, 40, 1, 0.0, tanh=True)
    assert ((kernels.network_output(x, layers, tanh=True) - y) ** 2).mean() < 0.05 * (y**2).mean()


def test_samples_from_sources(spark, small):
    x, _, samples, cohort, _ = small
    parts = {s: cohort.kept_samples([s]) for s in ("d0", "d1", "d2")}
    whole = atlas.samples_from_sources(parts)
    assert whole.cells.count() == 18 and whole.expr.count() == cohort.expr.count()
    with pytest.raises(errors.SampleError):
        atlas.samples_from_sources({"a": parts["d0"], " a ": parts["d1"]})
    with pytest.raises(errors.SampleError):
        atlas.samples_from_atlas(parts["d0"])


def test_streaming_scores(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "s", "c", "a", 2.0), ("2024-01-01 00:40:00", "s", "c", "b", 1.0), ("2024-01-02 00:00:00", "s", "c", "a", 5.0)], "t string, sample_id string, cell_id string, gene_id string, value double")
    rows.select(F.col("t").cast("timestamp").alias("ts"), "sample_id", "cell_id", "gene_id", "value").write.parquet(str(tmp_path / "in"))
    words = spark.createDataFrame([(0, "a", 0.5), (0, "b", 2.0)], "program_idx int, gene_id string, weight double")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = scored_stream(stream, words).writeStream.outputMode("complete").format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["score"] for r in spark.table("scored").collect()) == [2.5, 3.0]


def test_entry_and_catalogue(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.registered()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_queries_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    words = catalogue._words(catalogue._logged(spark, sf)).toPandas().pivot(index="gene_id", columns="program_idx", values="weight").fillna(0.0).sort_index()
    basis = words.to_numpy()
    cells = catalogue._atlas(spark, sf).expr.toPandas().pivot_table(index=["sample_id", "cell_id"], columns="gene_id", values="value", fill_value=0.0).reindex(columns=words.index, fill_value=0.0)
    supports = [[j for j in range(5) if mask >> j & 1] for mask in range(1, 32)]

    def best(x):
        tried = [(np.linalg.norm(x), np.zeros(5))]
        for on in supports:
            u = np.zeros(5)
            u[on] = np.linalg.lstsq(basis[:, on], x, rcond=None)[0]
            if (u >= 0).all():
                tried.append((np.linalg.norm(x - basis @ u), u))
        return min(tried, key=lambda t: t[0])

    found = {(r.sample_id, r.cell_id): r for r in catalogue.nnls_all(spark, sf).collect()}
    assert set(found) == set(cells.index)
    for at, x in zip(cells.index, cells.to_numpy()):
        error, usages = best(x)
        assert len(found[at].usages) == 5 and found[at].projection_error == pytest.approx(error, rel=1e-6, abs=1e-6)
        assert found[at].usages == pytest.approx(usages.tolist(), rel=1e-4, abs=1e-4)
    shares = catalogue.pca_explained_all(spark, sf).toPandas()["share"]
    assert len(shares) == 5 and shares.sum() == pytest.approx(1)
    assert sorted(r.program_idx for r in catalogue.bootstrap_all(spark, sf).collect()) == list(range(5))


def test_whole_benchmark_has_every_method(spark):
    found = catalogue.benchmark_all(spark, "/root/testdata/sf0.001").toPandas()
    assert set(found["method"]) == set(projection.available_projectors()) and found.groupby("method").size().eq(5).all()
    assert np.isfinite(found["mean_error"]).all()
