"""Scores of cells on a frozen vocabulary: joins and grouped sums that keep the values sparse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.errors import StateError
from cohortlens.operators.prep import ON, aligned, gene_moments
from cohortlens.schema import Cohort
from cohortlens.storage import stored


def basis(vocabulary: DataFrame) -> tuple[list[int], DataFrame]:
    """Program numbers in order, and a row per gene with a weight column w0, w1, ... for each program."""
    programs = sorted(r[0] for r in vocabulary.select("program_idx").distinct().collect())
    weight = [F.coalesce(F.max(F.when(F.col("program_idx") == k, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, k in enumerate(programs)]
    return programs, vocabulary.groupBy("gene_id").agg(*weight)


def products(cohort: Cohort, vocabulary: DataFrame, *extra: F.Column) -> tuple[list[int], DataFrame]:
    """Programs, and for every cell the sums of value times weight (s0, s1, ...; 0 without values) and the ``extra`` aggregates.

    One shuffle by cell, of one row a cell and task, whatever the number of programs.
    """
    programs, weights = basis(vocabulary)
    sums = [F.sum(F.col("value") * F.col(f"w{i}")).alias(f"s{i}") for i in range(len(programs))]
    found = cohort.expr.join(weights, "gene_id").groupBy(*ON).agg(*sums, *extra)
    return programs, cohort.cells.select(*ON).join(found, ON, "left").fillna(0.0, [f"s{i}" for i in range(len(programs))])


def long(wide: DataFrame, programs: list[int], score) -> DataFrame:
    """A row per cell and program from a row per cell; ``score`` gives the column of the i-th program."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("program_idx"), score(i).alias("score")) for i, k in enumerate(programs)]))
    return wide.select(*ON, each.alias("_p")).select(*ON, "_p.program_idx", "_p.score")


def direct(cohort: Cohort, vocabulary: DataFrame) -> DataFrame:
    """sample_id, cell_id, program_idx, score: the sum of value times weight."""
    own, _, _ = aligned(cohort, vocabulary)
    programs, wide = products(own, vocabulary)
    return long(wide, programs, lambda i: F.col(f"s{i}"))


def _by_program(rows: DataFrame, *columns: str) -> dict[int, tuple]:
    """A program's numbers; one row a program."""
    return {r["program_idx"]: tuple(r[c] for c in columns) for r in rows.collect()}


def gene_standardized(cohort: Cohort, vocabulary: DataFrame, training: list[str]) -> DataFrame:
    """Weights over values standardised by training means and deviations; centring is a constant per program."""
    own, _, _ = aligned(cohort, vocabulary)
    moments = gene_moments(own.kept_samples(training))
    sd = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0)
    scaled = stored(vocabulary.join(moments.select("gene_id", "mean", sd.alias("sd")), "gene_id").withColumn("weight", F.col("weight") / F.col("sd")))
    offset = _by_program(scaled.groupBy("program_idx").agg(F.sum(F.col("weight") * F.col("mean")).alias("offset")), "offset")
    programs, wide = products(own, scaled)
    return long(wide, programs, lambda i: F.col(f"s{i}") - F.lit(offset[programs[i]][0]))


def count_residual(cohort: Cohort, vocabulary: DataFrame, training: list[str], pseudocount: float = 1e-8) -> DataFrame:
    """Pearson residuals of counts against training rates, as two products; a cell without depth scores 0."""
    own, _, _ = aligned(cohort, vocabulary)
    totals = own.genes.join(own.kept_samples(training).expr.groupBy("gene_id").agg(F.sum("value").alias("t")), "gene_id", "left").fillna({"t": 0.0})
    totals = stored(totals.select("gene_id", (F.col("t") + pseudocount).alias("t")))
    rates = totals.select("gene_id", (F.col("t") / totals.agg(F.sum("t")).first()[0]).alias("rate"))
    rated = stored(vocabulary.join(rates, "gene_id"))
    expected = _by_program(rated.groupBy("program_idx").agg(F.sum(F.col("weight") * F.sqrt("rate")).alias("expected")), "expected")
    programs, wide = products(own, rated.withColumn("weight", F.col("weight") / F.sqrt("rate")), F.sum("value").alias("depth"))
    depth = F.col("depth")
    return long(wide, programs, lambda i: F.when(depth > 0, F.col(f"s{i}") / F.sqrt(depth) - F.sqrt(depth) * F.lit(expected[programs[i]][0])).otherwise(0.0))


def technical_residual(cohort: Cohort, vocabulary: DataFrame, training: list[str]) -> DataFrame:
    """Log values less their per-gene regression on log depth and log detected genes over the training cells.

    A score is linear in the coefficients, so the regression is one of each
    program's summed log values: one row a cell, and 3 + programs sums of
    products with the design leave the executors.
    """
    own, _, _ = aligned(cohort, vocabulary)
    logged = own.with_(expr=own.expr.select(*ON, "gene_id", F.log1p("value").alias("value")))
    raw = F.sum(F.expm1("value"))
    programs, wide = products(logged, vocabulary, F.log1p(raw).alias("d1"), F.log1p(F.count("*").cast("double")).alias("d2"))
    wide = stored(wide.fillna(0.0, ["d1", "d2"]))
    design = [F.lit(1.0), F.col("d1"), F.col("d2")]
    sums = [F.sum(a * b).alias(f"g{i}{j}") for i, a in enumerate(design) for j, b in enumerate(design)]
    sums += [F.sum(a * F.col(f"s{k}")).alias(f"c{i}_{k}") for i, a in enumerate(design) for k in range(len(programs))]
    r = wide.where(F.col("sample_id").isin(training)).agg(*sums).first()
    gram = np.array([[r[f"g{i}{j}"] for j in range(3)] for i in range(3)], float)
    cross = np.array([[r[f"c{i}_{k}"] for k in range(len(programs))] for i in range(3)], float)
    b = np.linalg.lstsq(gram, cross, rcond=None)[0]
    return long(wide, programs, lambda k: F.col(f"s{k}") - F.lit(float(b[0, k])) - F.lit(float(b[1, k])) * F.col("d1") - F.lit(float(b[2, k])) * F.col("d2"))


def matched_control(cohort: Cohort, vocabulary: DataFrame, training: list[str], n_top: int = 50, n_bins: int = 25, control_size: int = 50, seed: int = 0, uncontrolled: bool = False) -> DataFrame:
    """Weighted mean of a program's top genes less the mean of control genes of like training expression.

    Of each bin of a top gene, the ``control_size`` other genes of smallest hash
    (MD5 of ``seed:program:gene``) are controls, so a draw depends on nothing
    but these names. A program whose top genes fill their bins has no controls
    and raises; with ``uncontrolled`` its score is the mean of its top genes.
    """
    own, _, _ = aligned(cohort, vocabulary)
    means = gene_moments(own.kept_samples(training)).select("gene_id", "mean")
    rows = stored(vocabulary.select("program_idx", "gene_id", "gene_pos", "weight"))
    axis = rows.select("gene_id", "gene_pos").distinct().join(means, "gene_id")
    n = axis.count()
    place = F.row_number().over(Window.orderBy("mean", "gene_pos")) - 1  # the gene axis, one row a gene
    bins = axis.select("gene_id", F.floor(place * n_bins / n).alias("bin"))
    by_weight = Window.partitionBy("program_idx").orderBy(F.desc("weight"), "gene_pos")
    ranked = stored(rows.join(bins, "gene_id").withColumn("top", F.row_number().over(by_weight) <= n_top))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col("program_idx"), F.col("gene_id")))
    by_hash = Window.partitionBy("program_idx", "bin").orderBy(drawn, "gene_pos")
    others = ranked.where("not top").join(ranked.where("top").select("program_idx", "bin").distinct(), ["program_idx", "bin"], "left_semi")
    controls = others.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= control_size)
    each = Window.partitionBy("program_idx")
    signed = ranked.where("top").select("program_idx", "gene_id", F.try_divide("weight", F.sum("weight").over(each)).alias("weight"))
    signed = stored(signed.unionByName(controls.select("program_idx", "gene_id", (F.lit(-1.0) / F.count("*").over(each)).alias("weight"))))
    whole = signed.groupBy("program_idx").agg((F.count_if(F.col("weight").isNull()) > 0).alias("unweighted"), (F.count_if(F.col("weight") < 0) > 0).alias("controlled"))
    if whole.where("unweighted" if uncontrolled else "unweighted or not controlled").limit(1).count():
        raise StateError("a program has no control genes, or top genes without weight")
    programs, wide = products(own, signed)
    return long(wide, programs, lambda i: F.col(f"s{i}"))
