"""Workflows: cohort discovery, the train/validation/test pipeline, tuning and the promotion gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.errors import APIError, PipelineError, ValidationError
from cohortlens.operators import metrics, prep, programs, recurrence, scoring, state
from cohortlens.schema import Cohort
from cohortlens.sources import artifacts, results
from cohortlens.sources.atlas import named, relabelled, samples_from_atlas
from cohortlens.sources.results import AGREE
from cohortlens.storage import at_once, stored


#: What a workflow may be asked for, and its defaults: fixed values.
METHODS = ("cnmf", "nmf")
PREPROCESSING = ("identity", "library_size_log1p")
MITOCHONDRIAL, RIBOSOMAL = ("MT-",), ("RPS", "RPL")


@dataclass(frozen=True)
class FitOptions:
    n_programs: int = 8
    n_repeats: int = 3
    stability_threshold: float = 0.5
    preprocessing: str = "library_size_log1p"
    min_counts: float = 0
    min_genes: int = 0
    n_top_genes: int | None = None
    min_cells_per_gene: int = 0
    prefixes: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    seed: int = 0
    method: str = "nmf"
    max_iter: int = 500
    tol: float = 1e-4
    layer: str | None = None
    task_elements: int = 8_000_000

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise APIError(f"method {self.method} isn't one of {', '.join(METHODS)}")
        if self.preprocessing not in PREPROCESSING:
            raise APIError(f"preprocessing {self.preprocessing} isn't one of {', '.join(PREPROCESSING)}")
        if self.n_programs < 1 or self.n_repeats < 1:
            raise APIError("programs and repeats have to be positive")


def preprocessed(cohort: Cohort, name: str) -> Cohort:
    return prep.library_size_log1p(cohort) if name == "library_size_log1p" else cohort


def prepared(cohort: Cohort, o: FitOptions) -> Cohort:
    """Cell checks, gene selection, normalisation, in that order."""
    out = prep.validated(cohort.matrix(o.layer))
    if o.min_counts > 0 or o.min_genes > 0:
        out = prep.filtered_cells(out, o.min_counts, o.min_genes)
    else:  # no value is negative, so all cells stay: they aren't counted
        out = out.with_(**out._each(lambda x: x.join(out.cells.select(*prep.ON), prep.ON, "left_semi")))
    if o.n_top_genes is not None or o.min_cells_per_gene or o.prefixes or o.exclude:
        out = out.kept_genes(prep.selected_genes(out, None, o.n_top_genes, o.min_cells_per_gene, o.prefixes, o.exclude).select("gene_id"))
    return preprocessed(out, o.preprocessing)


def fit(cohort: Cohort, options: FitOptions = FitOptions()) -> dict[str, DataFrame]:
    """Programs, stability, usages and diagnostics of a single sample."""
    return fit_samples_results(prep.single_sample(cohort), options)


def fit_samples_results(cohort: Cohort, o: FitOptions) -> dict[str, DataFrame]:
    """Each sample of the cohort fitted on its own, on the genes that are selected over all."""
    return _fit_ready(prepared(cohort, o).stored(), o)


def _fit_ready(ready: Cohort, o: FitOptions) -> dict[str, DataFrame]:
    runs = stored(programs.fitted_programs(ready, o.n_programs, o.seed, o.n_repeats, programs.nmf_estimator(o.max_iter, o.tol), own_axis=True, task_elements=o.task_elements))
    if o.n_repeats > 1:
        found, stability = programs.stabilised(runs, o.stability_threshold)
        found = stored(found)
    else:
        found, stability = runs.drop("run", "sweeps", "error"), runs.sparkSession.createDataFrame([], "sample_id string, run int, anchor_idx int, matched_idx int, similarity double, retained boolean")
    on = ["sample_id", "gene_id"]
    sums = ready.expr.join(found.select(*on, "program_idx", "weight"), on).groupBy(*prep.ON, "program_idx").agg(F.sum(F.col("value") * F.col("weight")).alias("usage"))
    every = ready.cells.select(*prep.ON).join(found.select("sample_id", "program_idx").distinct(), "sample_id")
    usages = every.join(sums, [*prep.ON, "program_idx"], "left").fillna({"usage": 0.0})
    return {"programs": found, "stability": stability, "usages": usages, "diagnostics": programs.diagnostics(runs)}


def fit_atlas(cohort: Cohort, options: FitOptions = FitOptions(), min_samples: int = 2, min_similarity: float = 0.3, n_permutations: int = 1000, max_redundancy: float | None = None, sample_ids: list[str] | None = None, store: str | None = None, overwrite: bool = False) -> dict:
    """Fit every sample (or the named ones) on its own, then reduce; ``vocabulary`` is None if nothing recurs.

    Labels that differ by white space around them only are one sample. With a
    ``store``, samples that it has aren't fitted again (``fit_into``).
    """
    cohort = relabelled(cohort)
    cohort = cohort if sample_ids is None else cohort.known_samples([s.strip() for s in sample_ids])
    ids = samples_from_atlas(cohort)
    if not 2 <= min_samples <= len(ids):
        raise APIError(f"min_samples has to be 2 to {len(ids)}")
    if store:
        fit_into(cohort, store, options, overwrite=overwrite)
        fitted = results.load(cohort.cells.sparkSession, store, ids)[0]
    else:
        fitted = fit_samples_results(cohort, options)
    return aggregate(fitted, min_samples, min_similarity, n_permutations, max_redundancy, options.seed)


def settings(o: FitOptions) -> dict:
    """What results are saved with."""
    return {k: getattr(o, k) for k in (*AGREE, "n_programs", "seed", "layer")}


def fit_into(cohort: Cohort, path: str, options: FitOptions = FitOptions(), at_once: int = 16, overwrite: bool = False) -> list[str]:
    """Fit the samples that a store of results lacks (all, to overwrite) and return their ids.

    ``at_once`` samples are fitted together and added when they are done, so a
    run that was lost goes on with the samples that it hadn't added. Genes are
    selected over the whole cohort, so the result doesn't depend on that.
    """
    spark = cohort.cells.sparkSession
    kept = {} if overwrite else results.parameters_of(spark, path)
    if unlike := [k for k, v in settings(options).items() if kept and kept.get(k) != v]:
        raise APIError(f"the results of {path} were fitted with another {', '.join(unlike)}")
    cohort = relabelled(cohort)
    there = set() if overwrite else set(results.sample_ids(spark, path))
    left = [s for s in samples_from_atlas(cohort, 1) if s not in there]
    if left:
        ready = prepared(cohort, options).stored()
        for i in range(0, len(left), at_once):
            fitted = _fit_ready(ready.kept_samples(left[i : i + at_once]), options)
            fitted["usages"] = stored(fitted["usages"])  # checked, then written
            results.add(spark, path, fitted, settings(options), overwrite)
    return left


def fit_samples(sources: dict[str, Cohort], options: FitOptions = FitOptions(), min_samples: int = 2, **reduction) -> dict:
    """Fit each of several sources, a sample each, on the genes that it has itself, then reduce as ``fit_atlas`` does."""
    if not 2 <= min_samples <= len(sources):
        raise APIError(f"min_samples has to be 2 to {len(sources)}")
    parts = [fit_samples_results(named(prep.single_sample(one), name), options) for name, one in sources.items()]
    return aggregate(together(parts), min_samples, seed=options.seed, **reduction)


def together(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The union of results that were fitted apart; a sample may be in one only."""
    if not parts:
        raise APIError("there are no results to aggregate")
    out = {}
    for k in set.intersection(*(set(p) for p in parts)):
        every = parts[0][k]
        for p in parts[1:]:
            every = every.unionByName(p[k], allowMissingColumns=True)
        out[k] = every
    own = [p["programs"].select("sample_id").distinct() for p in parts]
    every = own[0]
    for o in own[1:]:
        every = every.unionAll(o)
    twice = every.groupBy("sample_id").count().where("count > 1").first()
    if twice:
        raise APIError(f"sample {twice['sample_id']} is in several results")
    return out


def aggregate(fitted: dict[str, DataFrame], min_samples: int = 2, min_similarity: float = 0.3, n_permutations: int = 1000, max_redundancy: float | None = None, seed: int = 0) -> dict:
    """The one reduction of per-sample results to recurrence and vocabulary."""
    found = recurrence.compute_recurrence(fitted["programs"], min_similarity, n_permutations, seed)
    built = recurrence.build_vocabulary(found, min_samples, max_redundancy)
    return fitted | {"recurrence": found, "vocabulary": built and built[0], "members": built and built[1]}


def saved_results(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Per-sample results below ``path`` (a store, one artifact, or a folder of them), and the settings that they share."""
    if results.is_store(spark, path):
        return results.load(spark, path)
    found = artifacts.load_each(spark, path, "programs")
    for key in AGREE:
        values: dict[str, list[str]] = {}
        for name, (_, parameters) in found.items():
            values.setdefault(str(parameters.get(key)), []).append(name)
        if len(values) > 1:
            raise APIError(f"results differ in {key}: {values}")
    return together([tables for tables, _ in found.values()]), next(iter(found.values()))[1]


@dataclass(frozen=True)
class PipelineConfig:
    validation: tuple[str, ...] = ()
    test: tuple[str, ...] = ()
    n_programs: int = 8
    scorer: str = "direct"
    preprocessing: str = "identity"
    min_samples: int = 2
    min_similarity: float = 0.3
    n_permutations: int = 1000
    n_components: int = 2
    seed: int = 0
    layer: str | None = None
    state_methods: tuple[str, ...] = ("direct", "linear", "nonlinear", "pca")
    most_elements: int = 10_000_000

    def __post_init__(self) -> None:
        if self.n_programs < 1 or self.n_components < 1 or self.min_samples < 2:
            raise PipelineError("programs and components have to be positive, min_samples at least 2")
        if self.preprocessing not in PREPROCESSING:
            raise PipelineError(f"preprocessing {self.preprocessing} isn't one of {', '.join(PREPROCESSING)}")
        if self.scorer not in SCORERS:
            raise PipelineError(f"unknown scorer {self.scorer}")
        if not self.state_methods or set(self.state_methods) - set(state.METHODS):
            raise PipelineError(f"state methods are some of {', '.join(state.METHODS)}")


@dataclass
class PipelineResult:
    config: PipelineConfig
    split: DataFrame
    vocabulary: DataFrame
    members: DataFrame
    scores: DataFrame
    coordinates: dict[str, DataFrame] = field(default_factory=dict)
    reports: dict[str, DataFrame] = field(default_factory=dict)


def _matched(c: Cohort, v: DataFrame, t: list[str]) -> DataFrame:
    n = v.select("gene_id").distinct().count()
    return scoring.matched_control(c, v, t, n_top=min(50, n - 1), n_bins=min(25, n))


SCORERS = {"direct": lambda c, v, t: scoring.direct(c, v), "gene_standardized": scoring.gene_standardized, "count_residual": scoring.count_residual, "technical_residual": scoring.technical_residual, "matched_control": _matched}


def fit_pipeline(cohort: Cohort, config: PipelineConfig, fitter=None) -> PipelineResult:
    """Programs of the training samples, their vocabulary, scores and states of all cells and reports by partition.

    Nothing fitted sees a held-out sample. Reports are ``reconstruction`` (of
    values by the vocabulary), ``associations``, and for each state method its
    reconstruction and the bootstrap of its coordinates over samples.
    """
    ready, train, out = _scored(cohort, config, fitter)
    out.reports["associations"] = metrics.technical_associations(out.scores, metrics.covariate_depth(ready))
    rows = stored(state.packed_scores(out.scores))

    def fitted(method: str) -> tuple[state.Fitted, DataFrame]:
        found = state.fitted(method, out.scores, ready, train, config.n_components, config.seed, config.most_elements, rows)
        return found, stored(found.coordinates)

    for method, (found, coordinates) in zip(config.state_methods, at_once(fitted, config.state_methods)):
        out.coordinates[method] = coordinates
        out.reports[f"{method}_reconstruction"] = found.reconstruction(out.split)
        each = coordinates.select(*prep.ON, F.posexplode("coordinates").alias("coordinate", "value"))
        out.reports[f"{method}_bootstrap"] = metrics.bootstrap_table(each, ["coordinate"], seed=config.seed)
    return out


def _scored(cohort: Cohort, config: PipelineConfig, fitter=None) -> tuple[Cohort, list[str], PipelineResult]:
    """The preprocessed cohort, its training samples, and the result up to the scores and how they give values back."""
    cohort = cohort.matrix(config.layer)
    split = prep.sample_split(prep.validated(cohort, 2), config.validation, config.test)
    train = [r["sample_id"] for r in split.where("partition = 'train'").orderBy("sample_id").collect()]
    if len(train) < 2:
        raise PipelineError("two training samples are needed")
    ready = preprocessed(cohort, config.preprocessing).stored()
    learn = ready.kept_samples(train)
    fitted = fitter(learn) if fitter else programs.fitted_programs(learn, config.n_programs, config.seed).drop("run", "sweeps", "error")
    vocabulary, members = recurrence.recurrent_vocabulary(fitted, min(config.min_samples, len(train)), config.min_similarity, config.n_permutations, seed=config.seed)
    scores = stored(SCORERS[config.scorer](ready, vocabulary, train))
    reports = {"reconstruction": metrics.reconstruction(ready, scores, vocabulary, split)}
    return ready, train, PipelineResult(config, split, vocabulary, members, scores, reports=reports)


def tuned(cohort: Cohort, candidates: list[PipelineConfig], fitter=None) -> tuple[int, list[float]]:
    """The candidate with the least validation error (the first of equals), and all errors."""
    if not candidates or len({c.test for c in candidates}) > 1 or any(not c.validation for c in candidates):
        raise PipelineError("candidates need validation samples and the same test samples")

    def error(c: PipelineConfig) -> float:  # states and associations don't bear on the choice
        return _scored(cohort, c, fitter)[2].reports["reconstruction"].where("partition = 'validation'").first()["mse"]

    errors = at_once(error, candidates)
    return min(range(len(errors)), key=lambda i: (errors[i], i)), errors


#: Gates in the order in which failures are named: fixed values.
GATES = (
    "independent study", "held-out transfer", "baseline comparison", "technical controls",
    "sample-level uncertainty", "recurrence diagnostics", "redundancy diagnostics", "post-fit interpretation",
)


def promotion(evidence: DataFrame) -> DataFrame:
    """Decision and failed gates for rows with a boolean column per gate (spaces and hyphens as underscores)."""
    columns = [g.replace(" ", "_").replace("-", "_") for g in GATES]
    if lost := set(columns) - set(evidence.columns):
        raise ValidationError(f"evidence lacks {sorted(lost)}")
    failed = F.filter(F.array(*[F.when(~F.col(c), F.lit(g)) for c, g in zip(columns, GATES)]), lambda x: x.isNotNull())
    decision = F.when(~F.col(columns[0]), "insufficient_evidence").when(F.size(failed) > 0, "retain_candidate").otherwise("promote")
    return evidence.withColumns({"decision": decision, "reasons": F.array_join(failed, "; ")})
