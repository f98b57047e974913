"""Which programs recur across samples: similarity, matching, medoid anchor, consensus vocabulary."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.errors import HierarchyError, RecurrenceError
from cohortlens.functions import kernels
from cohortlens.operators import programs as P
from cohortlens.schema import Cohort
from cohortlens.storage import at_once, stored

PAIR = ["ref_sample", "query_sample"]


def feature_overlap(programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genes that all samples have (gene_id, gene_pos), and shared counts of each pair (ref_sample < query_sample)."""
    own = programs.select("sample_id", "gene_id", "gene_pos").distinct()
    n = own.agg(F.countDistinct("sample_id")).first()[0]
    shared = own.groupBy("gene_id").agg(F.countDistinct("sample_id").alias("n"), F.min_by("gene_pos", "sample_id").alias("gene_pos")).where(F.col("n") == n).select("gene_id", "gene_pos")
    a, b = own.alias("a"), own.alias("b")
    both = a.join(b, (F.col("a.gene_id") == F.col("b.gene_id")) & (F.col("a.sample_id") < F.col("b.sample_id")))
    return shared, both.groupBy(F.col("a.sample_id").alias("ref_sample"), F.col("b.sample_id").alias("query_sample")).agg(F.count("*").alias("n_shared"))


def overlap_summary(programs: DataFrame, sharing: bool = False) -> DataFrame:
    """Of every sample its number of genes, how many all samples share, the share of its own that these are, and the least that any two samples share.

    Two samples without a common gene share 0; with ``sharing`` only pairs that
    share any gene count, and the least is null if there is none.
    """
    shared, pairs = feature_overlap(programs)
    n = shared.count()
    least = pairs.agg(F.min("n_shared")).first()[0]
    samples = programs.select("sample_id").distinct().count()
    if not sharing and (least is None or pairs.count() < samples * (samples - 1) // 2):
        least = n if samples < 2 else 0  # two samples without a common gene make no pair
    own = programs.groupBy("sample_id").agg(F.countDistinct("gene_id").alias("n_features"))
    return own.select("sample_id", "n_features", F.lit(n).cast("long").alias("n_shared"), (F.lit(n) / F.col("n_features")).alias("retention"), F.lit(least).cast("long").alias("minimum_pairwise_shared"))


def feature_map(programs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Where each gene of a vocabulary stands in it, and where in each sample's own axis."""
    axis = vocabulary.select("gene_id", F.col("gene_pos").alias("vocabulary_pos")).distinct()
    return programs.select("sample_id", "gene_id", "gene_pos").distinct().join(axis, "gene_id")


def ranked(rows: DataFrame, keys: list[str], value: str = "weight") -> DataFrame:
    """Add ``z``: average ranks of ``value`` within ``keys``, centred and scaled to length 1 (0 if constant)."""
    place, ties = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    out = rows.withColumn("_r", F.rank().over(place) + (F.count("*").over(ties) - 1) / 2)
    whole = Window.partitionBy(*keys)
    out = out.withColumn("_c", F.col("_r") - F.avg("_r").over(whole)).withColumn("_n", F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(whole)))
    return out.withColumn("z", F.when(F.col("_n") > 0, F.col("_c") / F.col("_n")).otherwise(0.0)).drop("_r", "_c", "_n")


def similarity_pairs(programs: DataFrame) -> DataFrame:
    """Spearman similarity of every two programs of different samples, over the genes that both samples have."""
    own = programs.select("sample_id", "gene_id").distinct()
    a, b = own.alias("a"), own.alias("b")
    both = a.join(b, (F.col("a.gene_id") == F.col("b.gene_id")) & (F.col("a.sample_id") < F.col("b.sample_id"))).select(F.col("a.sample_id").alias("ref_sample"), F.col("b.sample_id").alias("query_sample"), F.col("a.gene_id").alias("gene_id"))

    def side(name: str) -> DataFrame:
        rows = both.join(programs.select(F.col("sample_id").alias(name), "program_idx", "gene_id", "weight"), [name, "gene_id"])
        z = ranked(rows, [*PAIR, "program_idx"])
        return z.select(*PAIR, "gene_id", F.col("program_idx").alias(name.replace("sample", "idx")), F.col("z").alias(f"z_{name}"))

    joined = side("ref_sample").join(side("query_sample"), [*PAIR, "gene_id"])
    return joined.groupBy(*PAIR, "ref_idx", "query_idx").agg(F.sum(F.col("z_ref_sample") * F.col("z_query_sample")).alias("similarity"))


def redundancy(programs: DataFrame) -> DataFrame:
    """Mean and largest absolute similarity of a sample's different programs; 0 and 0 for a single one."""
    z = ranked(programs, ["sample_id", "program_idx"]).select("sample_id", "program_idx", "gene_id", "z")
    a, b = z.alias("a"), z.alias("b")
    on = (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.gene_id") == F.col("b.gene_id")) & (F.col("a.program_idx") < F.col("b.program_idx"))
    pairs = a.join(b, on).groupBy(F.col("a.sample_id").alias("sample_id"), F.col("a.program_idx").alias("i"), F.col("b.program_idx").alias("j")).agg(F.abs(F.sum(F.col("a.z") * F.col("b.z"))).alias("s"))
    found = pairs.groupBy("sample_id").agg(F.avg("s").alias("mean_similarity"), F.max("s").alias("max_similarity"))
    return programs.select("sample_id").distinct().join(found, "sample_id", "left").fillna({"mean_similarity": 0.0, "max_similarity": 0.0})


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return part.pivot(index="ref_idx", columns="query_idx", values="similarity").to_numpy()


#: Draws of a pair that are one row.
DRAWS = 250


def matched(similarity: DataFrame, n_permutations: int = 1000, seed: int = 0) -> DataFrame:
    """Best assignment of each pair of samples, against random assignments.

    Blocks of ``DRAWS`` draws are rows of their own, so the draws of one pair
    are spread, too; they depend on the seed, the pair's names and the block
    alone. n_permutations = 0 takes the exact mean of random assignments, the
    mean of the matrix, and no p value.
    """

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(part)
        rows, columns = kernels.assignment(m)
        return pd.DataFrame({"ref_sample": [key[0]], "query_sample": [key[1]], "optimal_mean": [m[rows, columns].mean()], "matrix_mean": [m.mean()], "n_ref": [len(m)], "scores": [m.ravel()]})

    best = similarity.groupBy(*PAIR).applyInPandas(solve, "ref_sample string, query_sample string, optimal_mean double, matrix_mean double, n_ref int, scores array<double>")
    if not n_permutations:
        none = F.lit(None).cast("double")
        return best.select(*PAIR, "optimal_mean", F.col("matrix_mean").alias("null_mean"), F.array().cast("array<double>").alias("null_scores"), none.alias("p_value"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ref, query, n_ref, scores, block in batch[[*PAIR, "n_ref", "scores", "block"]].itertuples(index=False, name=None):
                m = np.asarray(scores).reshape(n_ref, -1)
                rng = np.random.default_rng([seed, zlib.crc32(str(ref).encode()), zlib.crc32(str(query).encode()), block])
                n, size = min(DRAWS, n_permutations - block * DRAWS), min(m.shape)
                rows, columns = (rng.random((n, side)).argsort(1)[:, :size] for side in m.shape)
                out.append(m[rows, columns].mean(1))
            yield batch[[*PAIR, "optimal_mean", "block"]].assign(null=out)

    best = stored(best)
    blocks = best.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_permutations - 1) // DRAWS)))).repartition(*PAIR, "block")
    drawn = blocks.mapInPandas(draw, "ref_sample string, query_sample string, optimal_mean double, block int, null array<double>")
    every = drawn.groupBy(*PAIR, "optimal_mean").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "null"))), lambda x: x["null"])).alias("null_scores"))
    # the best assignment itself, drawn by chance, counts whatever the order of its sum
    reached = F.size(F.filter("null_scores", lambda x: x >= F.col("optimal_mean") - 1e-12))
    mean = F.aggregate("null_scores", F.lit(0.0), lambda s, x: s + x) / n_permutations
    return every.select(*PAIR, "optimal_mean", mean.alias("null_mean"), "null_scores", ((1 + reached) / (n_permutations + 1)).alias("p_value"))


def assignments(similarity: DataFrame, min_similarity: float | None = None) -> DataFrame:
    """ref_idx, query_idx and similarity of each pair's best matching; with a threshold a program may stay unmatched."""

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(part)
        rows, columns = kernels.assignment(m) if min_similarity is None else kernels.thresholded_assignment(m, min_similarity)
        return pd.DataFrame({"ref_sample": key[0], "query_sample": key[1], "ref_idx": rows.astype(np.int32), "query_idx": columns.astype(np.int32), "similarity": m[rows, columns]})

    return similarity.groupBy(*PAIR).applyInPandas(solve, "ref_sample string, query_sample string, ref_idx int, query_idx int, similarity double")


def adjusted_means(pairs: DataFrame) -> DataFrame:
    """Mean of optimal less null score over a sample's pairs; the medoid is the largest, of equals the first id."""
    gain = (F.col("optimal_mean") - F.col("null_mean")).alias("gain")
    both = pairs.select(F.col("ref_sample").alias("sample_id"), gain).unionByName(pairs.select(F.col("query_sample").alias("sample_id"), gain))
    return both.groupBy("sample_id").agg(F.avg("gain").alias("adjusted_mean"))


def medoid(pairs: DataFrame) -> str:
    return adjusted_means(pairs).orderBy(F.desc("adjusted_mean"), "sample_id").first()["sample_id"]


@dataclass(frozen=True)
class Recurrence:
    """Evidence without thresholds: pairs, the medoid, and its matches with every sample."""

    programs: DataFrame
    pairs: DataFrame
    reference: str
    matches: DataFrame
    shared: DataFrame


def evidence(found: Recurrence) -> dict[str, DataFrame]:
    """The tables of recurrence evidence, to be saved; ``restored`` is the way back."""
    return {"programs": found.programs, "pairs": found.pairs, "matches": found.matches, "shared": found.shared}


def restored(tables: dict[str, DataFrame], reference: str) -> Recurrence:
    return Recurrence(tables["programs"], tables["pairs"], reference, tables["matches"], tables["shared"])


def compute_recurrence(programs: DataFrame, min_similarity: float = 0.3, n_permutations: int = 1000, seed: int = 0) -> Recurrence:
    programs = stored(programs)
    shared = stored(feature_overlap(programs)[0])
    if programs.select("sample_id").distinct().limit(2).count() < 2 or shared.limit(2).count() < 2:
        raise RecurrenceError("recurrence needs two samples that share two genes")
    similarity = stored(similarity_pairs(programs))
    pairs = stored(matched(similarity, n_permutations, seed))
    first = medoid(pairs)
    turned = similarity.where(F.col("query_sample") == first).select(F.col("query_sample").alias("ref_sample"), F.col("ref_sample").alias("query_sample"), F.col("query_idx").alias("ref_idx"), F.col("ref_idx").alias("query_idx"), "similarity")
    against = similarity.where(F.col("ref_sample") == first).unionByName(turned)
    return Recurrence(programs, pairs, first, stored(assignments(against, min_similarity)), shared)


def vocabulary_members(found: Recurrence, min_samples: int) -> DataFrame:
    """anchor_idx, sample_id, program_idx, similarity of every anchor program with enough support; the anchor is a member."""
    own = found.programs.where(F.col("sample_id") == found.reference).select(F.col("program_idx").alias("anchor_idx")).distinct()
    anchors = own.select("anchor_idx", F.lit(found.reference).alias("sample_id"), F.col("anchor_idx").alias("program_idx"), F.lit(1.0).alias("similarity"))
    members = anchors.unionByName(found.matches.select(F.col("ref_idx").alias("anchor_idx"), F.col("query_sample").alias("sample_id"), F.col("query_idx").alias("program_idx"), "similarity"))
    return members.withColumn("support", F.count("*").over(Window.partitionBy("anchor_idx"))).where(F.col("support") >= min_samples)


def consensus(programs: DataFrame, members: DataFrame, shared: DataFrame) -> DataFrame:
    """Median weight of the members on the shared axis, each normalised there, and normalised again."""
    on_axis = P.normalised(programs.select("sample_id", "program_idx", "gene_id", "weight").join(shared, "gene_id"))
    rows = on_axis.join(members.select("anchor_idx", "sample_id", "program_idx"), ["sample_id", "program_idx"])
    medians = rows.groupBy("anchor_idx", "gene_id", "gene_pos").agg(F.median("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("anchor_idx"))
    return medians.withColumn("weight", F.col("weight") / total)


def pruned(vocabulary: DataFrame, max_redundancy: float) -> list[int]:
    """Anchors that stay when, in their order, one too similar to an earlier one that stayed is left out."""
    z = ranked(vocabulary.withColumn("sample_id", F.lit("v")).withColumnRenamed("anchor_idx", "program_idx"), ["program_idx"])
    a, b = z.alias("a"), z.alias("b")
    rows = a.join(b, (F.col("a.gene_id") == F.col("b.gene_id")) & (F.col("a.program_idx") < F.col("b.program_idx"))).groupBy(F.col("a.program_idx").alias("i"), F.col("b.program_idx").alias("j")).agg(F.sum(F.col("a.z") * F.col("b.z")).alias("s")).collect()
    near = {(r["i"], r["j"]): abs(r["s"]) for r in rows}
    stay: list[int] = []
    for k in sorted(r[0] for r in vocabulary.select("anchor_idx").distinct().collect()):
        if all(near[i, k] <= max_redundancy for i in stay):
            stay.append(k)
    return stay


def build_vocabulary(found: Recurrence, min_samples: int = 2, max_redundancy: float | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The vocabulary (program_idx, gene_id, gene_pos, weight) and its members, or None if nothing recurs."""
    members = stored(vocabulary_members(found, min_samples))
    words = stored(consensus(found.programs, members, found.shared))
    stay = pruned(words, max_redundancy) if max_redundancy is not None else sorted(r[0] for r in members.select("anchor_idx").distinct().collect())
    if not stay:
        return None
    number = F.create_map(*[F.lit(x) for i, k in enumerate(stay) for x in (k, i)])
    here = F.col("anchor_idx").isin(stay)
    at = number[F.col("anchor_idx")].cast("int").alias("program_idx")
    return words.where(here).select(at, "gene_id", "gene_pos", "weight"), members.where(here).withColumn("vocabulary_idx", number[F.col("anchor_idx")])


def recurrent_vocabulary(programs: DataFrame, min_samples: int = 2, min_similarity: float = 0.3, n_permutations: int = 1000, max_redundancy: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    built = build_vocabulary(compute_recurrence(programs, min_similarity, n_permutations, seed), min_samples, max_redundancy)
    if built is None:
        raise RecurrenceError("no program recurs")
    return built


def hierarchical_vocabularies(cohort: Cohort, fit, min_samples: int = 2, shared: bool = True, training: list[str] | None = None, **options) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """A vocabulary per lineage, and one that recurs across lineages.

    ``fit`` maps a cohort to programs; every lineage is fitted on its own, on
    the ``training`` samples if they are named.
    """
    if training is not None:
        cohort = cohort.known_samples(training)
    counts = cohort.cells.groupBy("lineage").agg(F.countDistinct("sample_id").alias("n")).orderBy("lineage").collect()
    if short := [r["lineage"] for r in counts if r["n"] < min_samples]:
        raise HierarchyError(f"lineages {short} have fewer than {min_samples} samples")
    if shared and len(counts) < 2:
        raise HierarchyError("a shared vocabulary needs two lineages")
    on, names = ["sample_id", "cell_id"], [r["lineage"] for r in counts]
    values = stored(cohort.expr.join(cohort.cells.select(*on, "lineage"), on), "lineage")

    def built(lineage: str) -> DataFrame:
        here = F.col("lineage") == lineage
        one = cohort.kept_cells(cohort.cells.where(here).select(*on)).with_(cells=cohort.cells.where(here), expr=values.where(here).select(cohort.expr.columns))
        return recurrent_vocabulary(fit(one), min_samples, **options)[0]

    found = dict(zip(names, at_once(built, names)))
    if not shared:
        return found, None
    parts = [v.select(F.lit(k).alias("sample_id"), "program_idx", "gene_id", "gene_pos", "weight") for k, v in found.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    built = build_vocabulary(compute_recurrence(every, **options), min(2, len(parts)))
    return found, built and built[0]
