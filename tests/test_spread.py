"""What is spread over tasks against one-task kernels and brute force; sources by key; a stream that is stopped and started again."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import errors
from cohortlens.functions import kernels
from cohortlens.functions.sparse import SparseRows
from cohortlens.operators import factorisation, metrics, programs, projection, recurrence, state
from cohortlens.plans import catalogue, pipeline
from cohortlens.sources import atlas
from cohortlens.storage import Bucketed
from cohortlens.streaming import projection as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logged(spark):
    return catalogue._logged(spark, SF)


# ---- factorisation


@pytest.mark.parametrize("options,own_axis", [({"max_iter": 8}, False), ({"max_iter": 5, "alpha_w": 1e-4, "l1_ratio": 0.3}, True)])
def test_spread_factorisation_equals_the_kernel(logged, options, own_axis, monkeypatch):
    monkeypatch.setattr(factorisation, "BLOCK_VALUES", 200)  # several blocks a sample
    monkeypatch.setattr(factorisation, "SENT_BYTES", 40_000)  # several groups of samples
    on, estimator = ["sample_id", "run", "program_idx", "gene_id"], programs.Nmf(**options)
    fit = lambda **more: programs.fitted_programs(logged, 3, 1, 2, estimator, own_axis, **more).toPandas().set_index(on).sort_index()
    one, spread = fit(), fit(task_elements=0)
    assert (one.index == spread.index).all() and (one.sweeps == spread.sweeps).all()
    assert np.abs(one.weight - spread.weight).max() < 1e-6 and np.allclose(one.error, spread.error, rtol=1e-6)


def test_sweeps_do_not_shuffle_cells(spark, logged):
    rows = programs.packed(logged, [r.gene_id for r in logged.genes.orderBy("gene_pos").collect()])
    cells = Bucketed.write(factorisation.blocks(rows), 4, "block")
    other = Bucketed.write(cells.read().select("block", F.lit("w").alias("kind")), 4, "block", dealt=True)
    plan = cells.read().join(other.read().hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    cells.drop(), other.drop()


def test_only_samples_beyond_a_task_are_spread(logged):
    sizes = {r.sample_id: r.n for r in logged.cells.groupBy("sample_id").agg(F.count("*").alias("n")).collect()}
    bound = sorted(sizes.values())[2] * logged.genes.count()
    found = programs.fitted_programs(logged, 2, estimator=programs.Nmf(max_iter=3), task_elements=bound)
    assert {r[0] for r in found.select("sample_id").distinct().collect()} == set(sizes)
    with pytest.raises(errors.ProgramError, match="dense matrices"):
        programs.fitted_programs(logged, 2, estimator=lambda x, k, seed: x[:k], task_elements=bound)


# ---- quadratic programs and projectors


def best_of_supports(gram, linear, total=None):
    """The least value over the minima of all sets of free variables that are feasible."""
    best, k = (0.0, np.zeros(len(linear))) if total is None else (np.inf, None), len(linear)
    for n in range(1, k + 1):
        for at in itertools.combinations(range(k), n):
            at = list(at)
            if total is None:
                h = np.linalg.solve(gram[np.ix_(at, at)], linear[at])
            else:
                system = np.block([[gram[np.ix_(at, at)], np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
                h = np.linalg.solve(system, np.r_[linear[at], total])[:-1]
            if (h >= 0).all():
                full = np.zeros(k)
                full[at] = h
                value = full @ gram @ full / 2 - linear @ full
                if value < best[0]:
                    best = value, full
    return best[1]


@pytest.mark.parametrize("total", [None, 1.0])
def test_batched_active_sets_equal_all_supports(total):
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 5):
        basis, x = rng.random((9, k)), rng.normal(0.2, 1, (60, 9))
        gram, linear = basis.T @ basis, x @ basis
        found = kernels.nonnegative_quadratics(gram, linear, total)
        assert np.allclose(found, [best_of_supports(gram, b, total) for b in linear], atol=1e-7)
    assert kernels.nonnegative_quadratics(np.eye(2), np.zeros((0, 2)), total).shape == (0, 2)


@pytest.mark.parametrize("name,l1,l2,total", [("nnls_all", 0, 0, None), ("ridge_nnls_all", 0.5, 0.1, None), ("simplex_all", 0, 0, 1.0)])
def test_whole_projections_equal_all_supports(spark, name, l1, l2, total):
    cohort, _, words = catalogue._start(spark, SF)
    genes, basis = projection.basis_of(words)
    rows = {(r.sample_id, r.cell_id): r for r in projection.packed(cohort, genes).collect()}
    found = catalogue.registered()[name](spark, SF).collect()
    assert len(found) == len(rows)
    gram = basis.T @ basis + l2 * np.eye(basis.shape[1])
    for r in found:
        x, one = np.zeros(len(genes)), rows[r.sample_id, r.cell_id]
        x[one.places] = one.found
        linear = (x / x.sum() if total else x) @ basis - l1
        want = best_of_supports(gram, linear, total)
        assert np.allclose(r.usages, want, rtol=1e-6, atol=1e-6 * max(1.0, want.max()))
        assert r.projection_error == pytest.approx(np.linalg.norm(x - basis @ want), rel=1e-6, abs=1e-5)


@pytest.mark.parametrize("dispersion", [None, 0.1])
def test_sparse_em_equals_dense_updates(dispersion):
    rng = np.random.default_rng(2)
    x, basis = rng.poisson(1.0, (30, 12)).astype(float), rng.random((12, 4))
    x[3] = 0
    scale, depth, share = basis / basis.sum(0), x.sum(1), np.full((30, 4), 0.25)
    for _ in range(40):
        mean = share @ scale.T
        weight = 1.0 if dispersion is None else 1 / (1 + dispersion * mean * np.maximum(depth, 1)[:, None])
        share = share * ((x * weight / mean) @ scale)
        share = np.divide(share, share.sum(1, keepdims=True), out=np.full((30, 4), 0.25), where=depth[:, None] > 0)
    assert np.allclose(kernels.mixture_em(SparseRows.of(x), basis, 40, 0.0, dispersion), share * depth[:, None], atol=1e-9)


# ---- principal components


def test_components_on_many_genes(spark):
    rng = np.random.default_rng(6)
    genes = [f"g{i:05d}" for i in range(30_000)]
    loadings = rng.random((3, 30_000)) * (rng.random((3, 30_000)) < 0.002)
    cells, values, dense = [], [], np.zeros((60, 30_000))
    for i in range(60):
        dense[i] = np.round(rng.gamma([3, 2, 1], 2) @ loadings, 3)
        cells.append((f"s{i % 3}", f"c{i}", "x"))
        values += [(f"s{i % 3}", f"c{i}", genes[j], float(dense[i, j])) for j in np.flatnonzero(dense[i])]
    cohort = atlas.from_rows(spark, cells, values, genes)
    found, model = state.expression_pca(cohort, ["s0", "s1"], 3)
    train = dense[[i for i in range(60) if i % 3 < 2]]
    centred = train - train.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs((model.axes * vt[:3]).sum(1)), 1, atol=1e-9)
    assert np.allclose(model.shares, s[:3] ** 2 / (s**2).sum(), atol=1e-9)
    want = (dense - train.mean(0)) @ model.axes.T
    assert all(np.allclose(r.coordinates, want[int(r.cell_id[1:])], atol=1e-8) for r in found.collect())


def test_components_equal_the_whole_decomposition(spark, logged):
    _, model = state.expression_pca(logged, catalogue.TRAIN, 3)
    genes = [r.gene_id for r in logged.genes.orderBy("gene_pos").collect()]
    rows = projection.packed(logged, genes).where(F.col("sample_id").isin(catalogue.TRAIN)).toPandas()
    x = np.asarray(SparseRows.packed(rows, len(genes)))
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.abs(model.axes @ vectors[:, ::-1][:, :3]), np.eye(3), atol=1e-6)
    assert np.allclose(model.shares, values[::-1][:3] / values.sum(), atol=1e-9)


# ---- quantiles and permutations


def test_quantiles_by_selection(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGES", 64)
    monkeypatch.setattr(metrics, "SORTED", 60)
    rng = np.random.default_rng(9)
    groups = {"ties": np.r_[np.zeros(700), rng.normal(size=50)], "normal": rng.normal(size=500), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "wide": np.sign(rng.normal(size=300)) * 10.0 ** rng.integers(-5, 5, 300) * (rng.random(300) < 0.5), "ends": np.r_[[-np.inf] * 30, rng.normal(size=40), [np.inf] * 30]}
    frame = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("none", None)], "g string, x double").repartition(5)
    at = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    found = {r.g: list(r)[1:] for r in metrics.quantiles(frame, ["g"], "x", at).collect()}
    assert set(found) == set(groups)
    for g, xs in groups.items():
        ordered, places = np.sort(xs), np.array(at) * (len(xs) - 1)
        want = [ordered[int(p)] if p == int(p) or ordered[int(p)] == ordered[int(p) + 1] else (int(p) + 1 - p) * ordered[int(p)] + (p - int(p)) * ordered[int(p) + 1] for p in places]
        assert np.allclose(found[g], want, rtol=1e-12), g
    few = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0)], "g string, x double")
    assert metrics.quantiles(few, ["g"], "x", [0.5]).first().q50 == 2.0


def test_permutations_do_not_depend_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("a", f"s{p}", i, j, float(rng.normal())) for p in range(4) for i in range(4) for j in range(5)] + [("a", "z", 0, 0, 0.5)]
    frame = spark.createDataFrame(rows, "ref_sample string, query_sample string, ref_idx int, query_idx int, similarity double")
    monkeypatch.setattr(recurrence, "DRAWS", 70)
    one, two = ({r.query_sample: r for r in recurrence.matched(f, 500, 5).collect()} for f in (frame, frame.repartition(11)))
    assert one == two and all(len(r.null_scores) == 500 for r in one.values())
    for q, r in one.items():
        m = np.array([x[4] for x in rows if x[1] == q]).reshape((4, 5) if q != "z" else (1, 1))
        every = [m[np.arange(len(m)), list(c)].mean() for c in itertools.permutations(range(m.shape[1]), len(m))]
        assert r.optimal_mean == pytest.approx(max(every)) and abs(r.null_mean - np.mean(every)) < 5 * np.std(every) / np.sqrt(500) + 1e-12
        assert r.p_value == (1 + sum(x >= max(every) - 1e-12 for x in r.null_scores)) / 501
    assert one["z"].p_value == 1.0


def test_matched_controls_are_drawn_by_hash(spark):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("score_matched_control", "score_matched_draws"):
        theirs = {(str(r[0]), str(r[1]), r[2]): r[3] for r in db.execute(f"SELECT sample_id, cell_id, program_idx, score FROM ({catalogue.ORACLE_SQL[name]})").fetchall()}
        ours = {(r.sample_id, r.cell_id, r.program_idx): r.score for r in catalogue.registered()[name](spark, SF).collect()}
        assert theirs.keys() == ours.keys() and all(abs(theirs[k] - ours[k]) < 2e-6 for k in ours)


# ---- sources and streams


def test_sources_are_split_by_their_own_key(spark):
    first = atlas.from_rows(spark, [("f", f"c{i}", "x") for i in range(4)], [("f", f"c{i}", g, i + 1) for i in range(4) for g in ("a", "b")])
    donors = F.element_at(F.array(*[F.lit(d) for d in ("d1", " d1 ", "d2", "d2")]), F.col("cell_pos").cast("int") + 1)
    first = first.with_(cells=first.cells.withColumn("donor", donors))
    second = atlas.from_rows(spark, [("f", "c0", "x")], [("f", "c0", g, 9) for g in ("b", "c")])
    both = atlas.samples_by_key([first, second.with_(cells=second.cells.withColumn("donor", F.lit("d3")))], "donor")
    assert sorted((r.sample_id, r.cell_id) for r in both.cells.collect()) == [("d1", "c0"), ("d1", "c1"), ("d2", "c2"), ("d2", "c3"), ("d3", "c0")]
    assert sorted(tuple(r) for r in both.expr.select("sample_id", "cell_id", "gene_id", "value").collect()) == [("d1", "c0", "b", 1.0), ("d1", "c1", "b", 2.0), ("d2", "c2", "b", 3.0), ("d2", "c3", "b", 4.0), ("d3", "c0", "b", 9.0)]
    with pytest.raises(errors.SampleError, match="d2"):
        atlas.samples_by_key([first, second.with_(cells=second.cells.withColumn("donor", F.lit("d2 ")))], "donor")
    for bad in (lambda: atlas.samples_by_key([], "donor"), lambda: atlas.samples_by_key([second], "donor"), lambda: atlas.samples_by_key([first], " "), lambda: atlas.samples_from_sources({})):
        with pytest.raises(errors.SampleError):
            bad()
    with pytest.raises(errors.SampleError, match="several samples"):
        atlas.samples_from_sources({"x": atlas.relabelled(first, "donor")})
    with pytest.raises(Exception, match="no donor"):
        atlas.relabelled(first.with_(cells=first.cells.withColumn("donor", F.lit("  "))), "donor").cells.collect()
    padded = first.with_(cells=first.cells.withColumn("sample_id", F.lit(" f ")), expr=first.expr.withColumn("sample_id", F.lit("f ")))
    assert {r[0] for t in (atlas.relabelled(padded).cells, atlas.relabelled(padded).expr) for r in t.select("sample_id").collect()} == {"f"}


def test_labels_are_trimmed_before_samples_are_fitted(spark):
    rng = np.random.default_rng(0)
    labels = ["a", " a", "b ", "b", "c", "c "]
    cells = [(labels[i % 6], f"c{i}", "x") for i in range(30)]
    values = [(s, c, f"g{j}", int(rng.integers(1, 9))) for s, c, _ in cells for j in range(4)]
    options = pipeline.FitOptions(n_programs=1, n_repeats=1, preprocessing="identity")
    found = pipeline.fit_atlas(atlas.from_rows(spark, cells, values), options, n_permutations=5, sample_ids=["a", "b "])
    assert sorted(r.sample_id for r in found["programs"].select("sample_id").distinct().collect()) == ["a", "b"]
    assert {r.sample_id: r.n for r in found["usages"].groupBy("sample_id").agg(F.countDistinct("cell_id").alias("n")).collect()} == {"a": 10, "b": 10}
    with pytest.raises(errors.SampleError, match="zz"):
        pipeline.fit_atlas(atlas.from_rows(spark, cells, values), options, sample_ids=["a", "zz"])


def test_a_stopped_stream_gives_each_cell_once(spark, tmp_path):
    cohort, _, words = catalogue._start(spark, SF)
    rows = cohort.expr.groupBy("sample_id", "cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_id", "value"))).alias("values"))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("cell_id"), F.lit(3))).persist()
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    write = lambda i: parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: streaming.project_stream(spark.readStream.schema(rows.schema).parquet(source), words, target, checkpoint)
    write(0)
    stream().awaitTermination()
    write(1)
    # a batch that stops after it has written, but before it is committed, runs again
    query = spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(lambda b, n: (streaming.project_batch(b, words).limit(3).write.mode("overwrite").parquet(f"{target}/batch={n}"), 1 / 0)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="division by zero"):
        query.awaitTermination()
    write(2)
    stream().awaitTermination()
    key = lambda r: (r.sample_id, r.cell_id)
    found, want = sorted(streaming.projected(spark, target).collect(), key=key), sorted(catalogue.nnls_all(spark, SF).collect(), key=key)
    assert [key(r) for r in found] == [key(r) for r in want] and all(np.allclose(a.usages, b.usages) for a, b in zip(found, want))
    with pytest.raises(errors.ProjectionError):
        streaming.project_batch(rows, words, "neural")
