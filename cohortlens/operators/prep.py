"""Checks, cell and gene selection, normalisation and splits. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.errors import APIError, DatasetError, InputError, StateError
from cohortlens.schema import Cohort

ON = ["sample_id", "cell_id"]


def summary(cohort: Cohort) -> DataFrame:
    """One row of counts and of what validation looks at."""
    cells = cohort.cells.agg(F.count("*").alias("n_cells"), F.countDistinct(*ON).alias("n_cell_ids"), F.countDistinct("sample_id").alias("n_samples"), F.count_if(F.coalesce(F.trim("sample_id"), F.lit("")) == "").alias("n_blank_samples"))
    genes = cohort.genes.agg(F.count("*").alias("n_genes"), F.countDistinct("gene_id").alias("n_gene_ids"))
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    values = cohort.expr.agg(F.count("*").alias("n_values"), F.count_if(bad).alias("n_not_finite"), F.count_if(F.col("value") < 0).alias("n_negative"))
    rows = cells.unionByName(genes, allowMissingColumns=True).unionByName(values, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])  # of three rows, each with its own columns


def validated(cohort: Cohort, min_samples: int = 1) -> Cohort:
    """The cohort itself, or the first error in a fixed order of checks."""
    s = summary(cohort).first()
    for wrong, said in (
        (not s["n_cells"] or not s["n_genes"], "there are no cells or no genes"),
        (s["n_cells"] != s["n_cell_ids"], "cell ids have to be unique"),
        (s["n_genes"] != s["n_gene_ids"], "gene ids have to be unique"),
        (s["n_blank_samples"], "every cell needs a sample id"),
        (s["n_samples"] < min_samples, f"{min_samples} samples are needed; there are {s['n_samples']}"),
        (s["n_not_finite"], "values have to be finite"),
        (s["n_negative"], "values can't be negative"),
    ):
        if wrong:
            raise InputError(said)
    return cohort


def cell_counts(cohort: Cohort) -> DataFrame:
    """total and detected genes of every cell, empty ones too."""
    sums = cohort.expr.groupBy(*ON).agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("detected"))
    return cohort.cells.join(sums, ON, "left").fillna({"total": 0.0, "detected": 0})


def filtered_cells(cohort: Cohort, min_counts: float = 0, min_genes: int = 0, max_cells_per_sample: int | None = None) -> Cohort:
    """Cells with enough counts and genes; of those the first N of each sample in order of position."""
    kept = cell_counts(cohort).where((F.col("total") >= min_counts) & (F.col("detected") >= min_genes))
    if max_cells_per_sample is not None:
        kept = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("cell_pos"))).where(F.col("_rank") <= max_cells_per_sample)
    return cohort.kept_cells(kept.select(*ON))


def gene_moments(cohort: Cohort, logged: bool = False) -> DataFrame:
    """gene_id, gene_pos, detected, mean and population variance over all cells, zeros included."""
    n = cohort.cells.count()
    if not n:
        raise DatasetError("there are no cells")
    x = F.log1p("value") if logged else F.col("value")
    sums = cohort.expr.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("detected"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    full = cohort.genes.join(sums, "gene_id", "left").fillna({"detected": 0, "_s": 0.0, "_q": 0.0})
    mean = F.col("_s") / n
    return full.select("gene_id", "gene_pos", "detected", mean.alias("mean"), F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0)).alias("variance"))


def selected_genes(cohort: Cohort, training: Sequence[str] | None = None, n_top: int | None = None, min_cells: int = 0, prefixes: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Genes that stay: detected in enough training cells, without unwanted ids, then the most variable by log counts.

    Of equal variances the later gene goes first. Prefixes and exclusions
    ignore case and hold for symbols and ids; mitochondrial genes are the
    prefix MT-, ribosomal RPS and RPL.
    """
    train = cohort.kept_samples(list(training)) if training is not None else cohort
    names = (F.upper("gene_id"), F.upper("_symbol"))
    wanted = F.col("detected") >= min_cells
    for p in prefixes:
        wanted = wanted & ~names[0].startswith(p.upper()) & ~names[1].startswith(p.upper())
    if exclude:
        wanted = wanted & ~names[0].isin([x.upper() for x in exclude]) & ~names[1].isin([x.upper() for x in exclude])
    symbols = cohort.genes.select("gene_id", cohort.symbols().alias("_symbol"))
    kept = gene_moments(train, logged=True).join(symbols, "gene_id").where(wanted).drop("_symbol")
    if n_top is not None:
        place = F.row_number().over(Window.orderBy(F.desc("variance"), F.desc("gene_pos")))  # the gene axis, one row a gene
        kept = kept.withColumn("_place", place).where(F.col("_place") <= n_top).drop("_place")
    return kept


def library_size_log1p(cohort: Cohort, target: float = 1e4) -> Cohort:
    """log1p of each value at a common depth; depth is over the genes that are there."""
    depth = F.sum("value").over(Window.partitionBy(*ON))
    return cohort.with_(expr=cohort.expr.withColumn("value", F.log1p(F.col("value") * target / F.greatest(depth, F.lit(1e-12)))))


def sample_split(cohort: Cohort, validation: Sequence[str] = (), test: Sequence[str] = ()) -> DataFrame:
    """sample_id and partition; samples that aren't held out train."""
    ids = {r[0] for r in cohort.cells.select("sample_id").distinct().collect()}
    if set(validation) & set(test):
        raise StateError("a sample can't be in two partitions")
    if unknown := (set(validation) | set(test)) - ids:
        raise StateError(f"unknown samples {sorted(unknown)}")
    if not ids - set(validation) - set(test):
        raise StateError("no sample is left to train on")
    rows = [(s, "validation" if s in validation else "test" if s in test else "train") for s in sorted(ids)]
    return cohort.cells.sparkSession.createDataFrame(rows, "sample_id string, partition string")


def partition_labels(cohort: Cohort, split: DataFrame) -> DataFrame:
    return cohort.cells.join(split, "sample_id")


def single_sample(cohort: Cohort) -> Cohort:
    n = cohort.cells.agg(F.countDistinct("sample_id")).first()[0]
    if n > 1:
        raise APIError(f"{n} samples; use fit_atlas, which fits each on its own")
    return cohort


def aligned(cohort: Cohort, vocabulary: DataFrame, strict: bool = True) -> tuple[Cohort, DataFrame, DataFrame]:
    """The cohort on the vocabulary's genes, and the missing and the extra ones; strict raises if any is missing."""
    wanted = vocabulary.select("gene_id", "gene_pos").distinct()
    missing = wanted.join(cohort.genes, "gene_id", "left_anti").select("gene_id")
    extra = cohort.genes.join(wanted, "gene_id", "left_anti").select("gene_id")
    if strict and missing.limit(1).count():
        raise StateError(f"genes of the vocabulary are missing, such as {missing.first()[0]}")
    here = wanted.join(cohort.genes.select("gene_id"), "gene_id", "left_semi")
    return cohort.with_(genes=here, expr=cohort.expr.join(here.select("gene_id"), "gene_id", "left_semi")), missing, extra
