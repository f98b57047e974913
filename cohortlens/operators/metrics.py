"""Reports by sample and partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.errors import MetricsError
from cohortlens.operators import scoring
from cohortlens.operators.prep import ON
from cohortlens.schema import Cohort
from cohortlens.storage import stored


def reconstruction(cohort: Cohort, scores: DataFrame, vocabulary: DataFrame, split: DataFrame) -> DataFrame:
    """Mean squared error and variance-weighted R2 of values against scores times weights, by partition.

    Zeros count: squares of the fit are summed by the programs' Gram matrix,
    so no cells x genes table is made. A cell's scores are one row; values are
    read once by cell and once by gene.
    """
    programs, weights = scoring.basis(vocabulary)
    k = range(len(programs))
    weights = stored(weights)
    g = weights.agg(F.count("*").alias("n"), *[F.sum(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"g{i}_{j}") for i in k for j in k if i <= j]).first()
    part = cohort.cells.join(split, "sample_id").select(*ON, "partition")
    own = cohort.with_(cells=part, expr=cohort.expr.join(weights.select("gene_id"), "gene_id", "left_semi"))
    _, wide = scoring.products(own, vocabulary, F.sum(F.col("value") * F.col("value")).alias("xx"))
    score = [F.coalesce(F.max(F.when(F.col("program_idx") == p, F.col("score"))), F.lit(0.0)).alias(f"f{i}") for i, p in enumerate(programs)]
    cells = wide.fillna(0.0, ["xx"]).join(scores.groupBy(*ON).agg(*score), ON, "left").fillna(0.0).join(part, ON)
    cross = sum((F.col(f"s{i}") * F.col(f"f{i}") for i in k), F.lit(0.0))
    fit = sum((F.col(f"f{i}") * F.col(f"f{j}") * F.lit(g[f"g{min(i, j)}_{max(i, j)}"]) for i in k for j in k), F.lit(0.0))
    sums = stored(cells.groupBy("partition").agg(F.count("*").alias("n_cells"), F.sum(F.col("xx") - 2 * cross + fit).alias("sse")))
    by_sample = own.expr.groupBy("sample_id", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    centred = by_sample.join(split, "sample_id").groupBy("partition", "gene_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = centred.join(sums.select("partition", "n_cells"), "partition").groupBy("partition").agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n_cells")).alias("sst"))
    joined = sums.join(spread, "partition", "left")
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(F.lit(float("nan")))
    return joined.select("partition", "n_cells", (F.col("sse") / (F.col("n_cells") * g["n"])).alias("mse"), r2.alias("r2"))


def model_reconstruction(rows: DataFrame, split: DataFrame, values: Callable[[pd.DataFrame], np.ndarray], model=None, at_once: int = 10_000) -> DataFrame:
    """The same for what a state model gives back of a cell's values (without a model: the values themselves).

    A task sends one row per partition and dimension, and takes ``at_once`` cells at a time.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, some in ((p, rows.iloc[a : a + at_once]) for p, rows in batch.groupby("partition") for a in range(0, len(rows), at_once)):
                x = values(some)
                rest = x - model.inverse(model.coordinates(x)) if model else np.zeros_like(x)
                now = np.array([np.full(x.shape[1], len(x)), (rest * rest).sum(0), x.sum(0), (x * x).sum(0)])
                found[part] = found[part] + now if part in found else now
        for part, (n, sse, s, q) in found.items():
            yield pd.DataFrame({"partition": part, "place": np.arange(len(n)), "n": n, "sse": sse, "s": s, "q": q})

    each = rows.join(split, "sample_id").mapInPandas(sums, "partition string, place long, n double, sse double, s double, q double")
    each = each.groupBy("partition", "place").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "s", "q")])
    whole = each.groupBy("partition").agg(F.max("n").cast("long").alias("n_cells"), (F.sum("sse") / F.sum("n")).alias("mse"), F.sum("sse").alias("_e"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("_t"))
    return whole.select("partition", "n_cells", "mse", F.when(F.col("_t") > 0, 1 - F.col("_e") / F.col("_t")).otherwise(F.lit(float("nan"))).alias("r2"))


def spread_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add average ranks of ``value`` within ``keys``; ranges of values are ranked apart, so a group of any size is spread over tasks.

    Equal values are counted first; ranges are shifted by the counts of the earlier ones.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranges = stored(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    before = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_start") + F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2
    ranks = ranges.join(starts, [*keys, "_part"]).withColumn(name, rank).drop("_n", "_part", "_start")
    return rows.join(ranks, [*keys, value])


def technical_associations(scores: DataFrame, covariates: DataFrame) -> DataFrame:
    """Spearman correlation of each program's scores with each covariate (sample_id, cell_id, covariate, x)."""
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    key = ["program_idx", "covariate"]
    rows = stored(scores.join(covariates.where(finite), ON).select(*key, "score", "x"))
    ranked = spread_ranks(spread_ranks(rows, key, "score", "_a"), key, "x", "_b")
    found = ranked.groupBy(*key).agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_ab"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    undefined = (F.col("n") < 2) | (F.col("_sa") == 0) | (F.col("_sb") == 0)
    return found.select(*key, "n", F.when(undefined, F.lit(float("nan"))).otherwise(F.try_divide("_ab", F.col("_sa") * F.col("_sb"))).alias("rho"))


def sample_means(values: DataFrame, value: str = "value") -> DataFrame:
    return values.groupBy("sample_id").agg(F.avg(value).alias("mean"))


def bootstrap_estimate(values: DataFrame, value: str = "value") -> DataFrame:
    """Mean of the samples' means, whatever their numbers of cells."""
    return sample_means(values, value).agg(F.avg("mean").alias("estimate"), F.count("*").alias("n_samples"))


def bootstrap_table(values: DataFrame, keys: list[str], value: str = "value", n_bootstrap: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Estimate and interval for each group of ``keys`` (a coordinate, a program) from resampling samples, not cells.

    Only a mean per sample and group is resampled. Samples are taken in order
    of their ids, with the same draws for every group.
    """
    if not 0 < confidence < 1 or n_bootstrap < 1:
        raise MetricsError("a bootstrap needs resamples and a confidence between 0 and 1")
    means = values.groupBy(*keys, "sample_id").agg(F.avg(value).alias("mean"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in means.schema if f.name in keys)

    def resampled(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        mean = part.sort_values("sample_id")["mean"].to_numpy()
        draws = np.random.default_rng(seed).integers(0, len(mean), (n_bootstrap, len(mean)))
        low, high = np.quantile(mean[draws].mean(1), [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame([[*key, mean.mean(), low, high, len(mean)]], columns=[*keys, "estimate", "low", "high", "n_samples"])

    return means.groupBy(*keys).applyInPandas(resampled, f"{kinds}, estimate double, low double, high double, n_samples long")


def sample_bootstrap(values: DataFrame, value: str = "value", n_bootstrap: int = 2000, confidence: float = 0.95, seed: int = 0) -> dict[str, float]:
    """The same for all rows as one group."""
    found = bootstrap_table(values.withColumn("_all", F.lit(0)), ["_all"], value, n_bootstrap, confidence, seed).drop("_all").first()
    if found is None:
        raise MetricsError("a bootstrap needs samples")
    return found.asDict()


#: Ranges that a pass of a selection counts, and a count from which the rest is sorted.
RANGES, SORTED = 1024, 50_000


def quantiles(values: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation; nulls don't count, NaN is the largest value.

    Selection by counting: the range of each wanted rank is cut into ``RANGES``
    parts, whose counts combine on the map side, and the part that holds the
    rank is cut again; at most ``SORTED`` values are sorted in the end. So no
    task holds a group, and only counts are shuffled.
    """
    infinite = float("inf")
    rows = stored(values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x")))
    finite = ~F.isnan("_x") & (F.abs("_x") < infinite)
    ends = F.min(F.when(finite, F.col("_x"))).alias("_lo"), F.max(F.when(finite, F.col("_x"))).alias("_hi")
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(F.when(F.col("_x") == -infinite, 1)).alias("_low"), F.count(F.when(finite, 1)).alias("_mid"), F.count(F.when(F.col("_x") == infinite, 1)).alias("_high"), *ends))
    place = [q * (F.col("_n") - 1) for q in at]
    wanted = F.explode(F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))).alias("_rank")
    aims = groups.select(*keys, "_lo", "_hi", "_low", "_mid", "_high", wanted)
    inner = F.col("_rank") - F.col("_low")
    outer = F.when(inner < 0, -infinite).when(inner < F.col("_mid"), F.lit(None)).when(inner < F.col("_mid") + F.col("_high"), infinite).otherwise(float("nan"))
    aims = stored(aims.withColumn("_value", outer.cast("double")).select(*keys, "_rank", "_lo", "_hi", "_value", inner.alias("_k"), F.col("_mid").alias("_count")))
    found, aims = aims.where("_value IS NOT NULL").select(*keys, "_rank", "_value"), aims.where("_value IS NULL")
    rest = []
    while True:
        done = F.col("_lo") == F.col("_hi")
        found = found.unionByName(aims.where(done).select(*keys, "_rank", F.col("_lo").alias("_value")))
        rest.append(aims.where(~done & (F.col("_count") <= SORTED)).select(*keys, "_rank", "_lo", "_hi", "_k"))
        aims = aims.where(~done & (F.col("_count") > SORTED))
        if not aims.limit(1).count():
            break
        part = F.least(F.lit(RANGES - 1), F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * RANGES))
        spans = aims.select(*keys, "_lo", "_hi").distinct()
        counts = rows.join(spans, keys).where("_x BETWEEN _lo AND _hi").groupBy(*keys, "_lo", "_hi", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = aims.join(counts.withColumn("_before", before), [*keys, "_lo", "_hi"]).where("_k >= _before AND _k < _before + _c")
        aims = stored(held.select(*keys, "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), (F.col("_k") - F.col("_before")).alias("_k"), F.col("_c").alias("_count")))
    here = rows.join(reduce(DataFrame.unionByName, rest), keys).where("_x BETWEEN _lo AND _hi")
    order = F.row_number().over(Window.partitionBy(*keys, "_rank").orderBy("_x")) - 1
    found = found.unionByName(here.withColumn("_o", order).where("_o = _k").select(*keys, "_rank", F.col("_x").alias("_value")))
    got = groups.join(found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")), keys)
    each = lambda p: F.when(F.floor(p) == F.ceil(p), F.col("_at")[F.floor(p).cast("long")]).otherwise((F.ceil(p) - p) * F.col("_at")[F.floor(p).cast("long")] + (p - F.floor(p)) * F.col("_at")[F.ceil(p).cast("long")])
    return got.select(*keys, *[each(p).alias(f"q{round(100 * q):02d}") for q, p in zip(at, place)])


def covariate_depth(cohort: Cohort) -> DataFrame:
    return cohort.expr.groupBy(*ON).agg(F.sum("value").alias("x")).withColumn("covariate", F.lit("depth"))


