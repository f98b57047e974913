"""Many matrix triples in one plan, the store of results, and projection from SQL text."""

from __future__ import annotations

import tarfile

import numpy as np
import pytest

from cohortlens import cli, errors
from cohortlens.plans import pipeline
from cohortlens.sources import artifacts, matrix_market, results
from tests.test_core import blocks, write_triple


def test_triples_of_many_samples_are_one_plan(spark, tmp_path):
    def jobs(n, group):
        folder = tmp_path / group
        folder.mkdir()
        for i in range(n):
            genes = ["A", "B"] if i % 2 else ["B", "C", "A"]
            write_triple(folder, f"GSM{i}_x y_", genes, [f"c{k}" for k in range(40)], [(1 + k % 2, k + 1, k + 1) for k in range(40)], i % 3 == 0)
        spark.sparkContext.setJobGroup(group, group)
        cohort = matrix_market.read_10x_samples(spark, str(folder))
        rows = {tuple(r) for r in cohort.expr.collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [r["gene_id"] for r in cohort.genes.orderBy("gene_pos").collect()] == ["B", "A"]
        order = lambda i: ["A", "B"] if i % 2 else ["B", "C"]
        assert rows == {(f"GSM{i}", f"GSM{i}:c{k}", order(i)[k % 2], k + 1.0) for i in range(n) for k in range(40) if order(i)[k % 2] != "C"}
        assert {(r["sample_id"], r["cell_pos"]) for r in cohort.cells.collect()} == {(f"GSM{i}", k) for i in range(n) for k in range(40)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(9, "nine") <= jobs(2, "two") + 4  # the optimiser's own joins may differ, not a job a sample


def test_files_in_blocks_keep_their_lines_in_order(spark, tmp_path):
    genes, cells = [f"g{i}" for i in range(300)], [f"b{i}" for i in range(500)]
    write_triple(tmp_path, "GSM1_", genes, cells, [(1 + k % 300, 1 + k % 500, k + 1) for k in range(1500)], False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        cohort = matrix_market.read_10x_samples(spark, str(tmp_path))
        found = {(r["cell_id"], r["gene_id"], r["value"]) for r in cohort.expr.collect()}
        places = [r["cell_id"] for r in cohort.cells.orderBy("cell_pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {(f"GSM1:b{k % 500}", f"g{k % 300}", k + 1.0) for k in range(1500)}
    assert places == [f"GSM1:{c}" for c in cells]


@pytest.mark.parametrize("suffix", ["tar", "tar.gz"])
def test_archive_members_are_tasks(spark, tmp_path, suffix, monkeypatch):
    monkeypatch.setattr(matrix_market, "LINES", 3)
    for i in range(3):
        write_triple(tmp_path, f"GSM{i}_", ["A", "B"], ["x", "y", "z", "w", "v"], [(1, 2, i + 1), (2, 5, 7)], i % 2 == 0)
    with tarfile.open(tmp_path / f"all.{suffix}", "w:gz" if suffix == "tar.gz" else "w") as archive:
        for f in sorted(tmp_path.glob("GSM*")):
            archive.add(f, f"deep/er/{f.name}")
    cohort = matrix_market.read_10x_samples(spark, str(tmp_path / f"all.{suffix}"))
    assert {tuple(r) for r in cohort.expr.collect()} == {x for i in range(3) for x in ((f"GSM{i}", f"GSM{i}:y", "A", i + 1.0), (f"GSM{i}", f"GSM{i}:v", "B", 7.0))}
    if suffix == "tar":
        rows = matrix_market._archive(spark, str(tmp_path / "all.tar"))[1](["deep/er/GSM1_matrix.mtx"])
        assert rows.count() == 5


def test_faulty_triples_name_their_sample(spark, tmp_path):
    write_triple(tmp_path, "GSM1_", ["A"], ["x"], [(1, 1, 1)], False)
    write_triple(tmp_path, "GSM2_", ["A"], ["x", "x"], [(1, 1, 1)], False)
    with pytest.raises(errors.DatasetError, match="GSM2: barcode x occurs twice"):
        matrix_market.read_10x_samples(spark, str(tmp_path))
    (tmp_path / "GSM2_barcodes.tsv").write_text("x\n")
    with pytest.raises(errors.DatasetError, match="GSM2: the matrix is"):
        matrix_market.read_10x_samples(spark, str(tmp_path))
    assert matrix_market.read_10x_samples(spark, str(tmp_path), ["GSM1"]).cells.count() == 1


def result(spark, **samples):
    """Two programs on three genes; samples: name -> number of cells."""
    programs = [(s, k, g, i, 1.0 + k + i) for s in samples for k in range(2) for i, g in enumerate("ABC")]
    usages = [(s, f"{s}:{c}", k, float(n + k)) for s, n in samples.items() for c in range(n) for k in range(2)]
    return {"programs": spark.createDataFrame(programs, "sample_id string, program_idx int, gene_id string, gene_pos int, weight double"), "usages": spark.createDataFrame(usages, "sample_id string, cell_id string, program_idx int, usage double")}


SETTINGS = {"method": "nmf", "preprocessing": "identity", "n_repeats": 1}


def counted(spark, path):
    return {r["sample_id"]: r["count"] for r in results.load(spark, path)[0]["usages"].groupBy("sample_id").count().collect()}


def test_a_store_grows_and_replaces_samples(spark, tmp_path):
    path = str(tmp_path / "store")
    assert not results.is_store(spark, path)
    assert results.add(spark, path, result(spark, **{"01": 3, "../up": 2}), SETTINGS) == ["../up", "01"]
    assert results.add(spark, path, result(spark, c=1), SETTINGS) == ["c"]
    assert counted(spark, path) == {"01": 6, "../up": 4, "c": 2} and not (tmp_path / "up").exists()
    with pytest.raises(errors.InputError, match="in the store already"):
        results.add(spark, path, result(spark, **{" 01 ": 5, "d": 1}), SETTINGS)
    assert results.sample_ids(spark, path) == ["../up", "01", "c"]
    results.add(spark, path, result(spark, **{" 01 ": 5}), SETTINGS, overwrite=True)
    assert counted(spark, path) == {"01": 10, "../up": 4, "c": 2}
    tables, parameters = results.load(spark, path, ["c"])
    assert parameters == SETTINGS and tables["programs"].count() == 6 and tables["programs"].columns[0] == "sample_id"
    assert results.vacuum(spark, path) == 0  # the first version still holds ../up
    results.add(spark, path, result(spark, **{"../up": 7}), SETTINGS, overwrite=True)
    assert results.vacuum(spark, path) == 1 and counted(spark, path) == {"01": 10, "../up": 14, "c": 2}


def test_a_failed_addition_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    results.add(spark, path, result(spark, a=3, b=2), SETTINGS)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(results._Files, "publish", lost)
        with pytest.raises(RuntimeError):
            results.add(spark, path, result(spark, a=9, z=1), SETTINGS, overwrite=True)
    assert counted(spark, path) == {"a": 6, "b": 4}
    results.add(spark, path, result(spark, a=4), SETTINGS, overwrite=True)
    assert counted(spark, path) == {"a": 8, "b": 4}
    assert results.vacuum(spark, path) == 1
    monkeypatch.setattr(results, "_manifest", lambda f, real=results._manifest: (real(f)[0] - 1, real(f)[1]))
    with pytest.raises(errors.InputError, match="another writer"):
        results.add(spark, path, result(spark, y=1), SETTINGS)


@pytest.mark.parametrize(
    ("table", "change", "said"),
    [
        ("usages", "SELECT * FROM {t} UNION ALL SELECT * FROM {t} WHERE cell_id = 'a:0'", "cell ids have to be unique"),
        ("programs", "SELECT * FROM {t} UNION ALL SELECT * FROM {t} WHERE gene_id = 'A'", "a gene of a program occurs twice"),
        ("programs", "SELECT sample_id, program_idx, gene_id, gene_pos, IF(program_idx = 1, 0D, weight) AS weight FROM {t}", r"empty programs at indices \[1\]"),
        ("programs", "SELECT * FROM {t} WHERE program_idx = 0 OR gene_id <> 'C'", "different genes"),
        ("programs", "SELECT sample_id, program_idx, gene_id, gene_pos + program_idx AS gene_pos, weight FROM {t}", "different genes"),
        ("programs", "SELECT sample_id, program_idx, gene_id, gene_pos, IF(gene_id = 'B', double('NaN'), weight) AS weight FROM {t}", "finite"),
        ("usages", "SELECT sample_id, cell_id, program_idx + 1 AS program_idx, usage FROM {t}", "aren't of its 2 programs"),
        ("usages", "SELECT sample_id, cell_id, program_idx, -usage AS usage FROM {t}", "not negative"),
        ("usages", "SELECT string(NULL) AS sample_id, cell_id, program_idx, usage FROM {t}", "needs a sample id"),
        ("usages", "SELECT * FROM {t} WHERE false", "no cells"),
    ],
)
def test_faulty_results_are_refused(spark, tmp_path, table, change, said):
    tables = result(spark, a=3)
    tables[table] = spark.sql(change, t=tables[table])
    with pytest.raises(errors.InputError, match=said):
        results.add(spark, str(tmp_path / "store"), tables, SETTINGS)
    assert not results.is_store(spark, str(tmp_path / "store"))


def test_other_tables_settings_and_tampered_rows_are_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    tables = result(spark, a=3)
    with pytest.raises(errors.InputError, match="expression matrix"):
        results.add(spark, path, tables | {"expr": tables["usages"]}, SETTINGS)
    with pytest.raises(errors.InputError, match="name their method"):
        results.add(spark, path, tables, {"preprocessing": "identity", "n_repeats": 1})
    with pytest.raises(errors.InputError, match="no results"):
        results.load(spark, path)
    results.add(spark, path, tables, SETTINGS)
    with pytest.raises(errors.InputError, match="differ in n_repeats"):
        results.add(spark, path, result(spark, b=1), SETTINGS | {"n_repeats": 3})
    with pytest.raises(errors.InputError, match="no samples"):
        results.load(spark, path, ["b"])
    version = next((tmp_path / "store" / "tables" / "usages").glob("version=*"))
    result(spark, a=1)["usages"].write.mode("overwrite").partitionBy("sample_id").parquet(str(version))
    with pytest.raises(errors.InputError, match="aren't those that were stored"):
        results.load(spark, path)


def test_a_large_sample_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "ROWS", 20)
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        results.add(spark, path, result(spark, big=100, little=3), SETTINGS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda s: len(list((tmp_path / "store" / "tables" / "usages").glob(f"version=*/sample_id={s}/*.parquet")))
    assert files("big") > 1 and files("little") == 1 and counted(spark, path) == {"big": 200, "little": 6}


def test_a_cohort_fit_goes_on_where_it_was_lost(spark, tmp_path, monkeypatch):
    cohort, path = blocks(spark), str(tmp_path / "store")
    options = pipeline.FitOptions(2, 2, preprocessing="identity")
    done, real = [], results.add

    def add(spark, where, *rest, **kw):
        if len(done) == 1:
            raise RuntimeError("driver lost")
        done.append(real(spark, where, *rest, **kw))

    with monkeypatch.context() as m:
        m.setattr(results, "add", add)
        with pytest.raises(RuntimeError):
            pipeline.fit_into(cohort, path, options, at_once=1)
    assert results.sample_ids(spark, path) == done[0]
    with pytest.raises(errors.APIError, match="seed"):
        pipeline.fit_into(cohort, path, pipeline.FitOptions(2, 2, preprocessing="identity", seed=4))
    whole = pipeline.fit_atlas(cohort, options, min_similarity=0.0, n_permutations=5, store=path)
    apart = pipeline.fit_atlas(cohort, options, min_similarity=0.0, n_permutations=5)
    for name in ("programs", "usages", "vocabulary"):
        one, two = (x[name].sort(*[c for c in x[name].columns if c not in ("weight", "usage")]).toPandas()[sorted(x[name].columns)] for x in (whole, apart))
        assert len(one) and np.allclose(one.select_dtypes("number"), two.select_dtypes("number")) and one.select_dtypes(exclude="number").equals(two.select_dtypes(exclude="number"))
    assert len(results.sample_ids(spark, path)) == 3


def test_command_line_refits_one_sample_of_a_store(spark, tmp_path):
    cohort = blocks(spark)
    cli.save_cohort(cohort, str(tmp_path / "in"))
    first = results.add(spark, str(tmp_path / "out" / "samples"), pipeline.fit_samples_results(cohort, pipeline.FitOptions(2, 2, preprocessing="identity", method="cnmf")), pipeline.settings(pipeline.FitOptions(2, 2, preprocessing="identity", method="cnmf")))
    cli.save_cohort(cohort.kept_samples(first[:1]), str(tmp_path / "one"))
    refit = ["fit", "--input", str(tmp_path / "one"), "--sample-id", first[0], "--output", str(tmp_path / "out" / "samples"), "--n-programs", "2", "--n-repeats", "2", "--preprocessing", "identity", "--seed", "7"]
    with pytest.raises(errors.InputError, match="in the store already"):
        cli.main(refit, spark)
    assert cli.main([*refit, "--overwrite"], spark) == 0
    assert results.sample_ids(spark, str(tmp_path / "out" / "samples")) == first
    assert cli.main(["aggregate", "--input", str(tmp_path / "out" / "samples"), "--output", str(tmp_path / "again"), "--min-similarity", "0.0", "--n-permutations", "5"], spark) == 0
    assert results.sample_ids(spark, str(tmp_path / "again" / "samples")) == first


def test_a_run_is_recorded_once_it_is_done(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    argv = ["aggregate", "--input", "somewhere", "--output", out, "--max-redundancy", "0.5"]
    with monkeypatch.context() as m:
        m.setitem(cli.COMMANDS, "aggregate", lambda *_: (_ for _ in ()).throw(errors.APIError("no")))
        with pytest.raises(errors.APIError):
            cli.main(argv, spark)
        assert not (tmp_path / "out").exists()
        m.setitem(cli.COMMANDS, "aggregate", lambda *_: None)
        assert cli.main(argv, spark) == cli.main([*argv, "--seed", "5"], spark) == 0
    found = artifacts.load_run(spark, out)
    assert found["command"] == "aggregate" and found["arguments"]["max_redundancy"] == 0.5 and found["arguments"]["seed"] == 5
    assert found["environment"]["spark"] == spark.version and set(found["environment"]) == {"cohortlens", "spark", "python", "numpy", "pandas", "pyarrow"}
    with pytest.raises(errors.InputError):
        artifacts.load_each(spark, out, "programs")  # the record isn't a result
