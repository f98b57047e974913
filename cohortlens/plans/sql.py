"""Projection and scores from SQL text: a table function over whole cells, and scalar functions that stay in the JVM.

The table function takes rows with ``sample_id``, ``cell_id`` and ``values``, a
map of a cell's non-zero values by gene id (``whole_cells``). The scalar ones
take arrays, places on a gene axis and the values there (``placed_cells``), and
a program's weights along that axis (``placed_programs``). After ``register``::

    SELECT * FROM project_cells(TABLE(cells))
    SELECT cell_id, program_score(places, log1p_values(found, 1e4D), weights) FROM ...

Edge cases: a null map is a cell without values, whose usages are 0; null
values count as 0; genes outside the vocabulary are ignored; an empty table
gives no rows; null arrays have depth, detected genes and scores of 0; places
beyond the weights weigh 0; usages that sum to 0 have shares of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.errors import ProjectionError
from cohortlens.functions.sparse import SparseRows
from cohortlens.operators import prep, projection
from cohortlens.schema import Cohort
from cohortlens.sources.artifacts import stored_vocabulary
from cohortlens.streaming.projection import PER_CELL

#: Values of cells that a task holds at a time.
ELEMENTS = 1 << 22
#: Scalar functions, as SQL: parameters, result, body.
SCALARS = {
    "cell_depth": ("found ARRAY<DOUBLE>", "DOUBLE", "coalesce(aggregate(found, 0D, (s, x) -> s + coalesce(x, 0D)), 0D)"),
    "cell_detected": ("found ARRAY<DOUBLE>", "INT", "greatest(size(filter(found, x -> x > 0)), 0)"),
    # the depth is computed once, not for each value
    "log1p_values": ("found ARRAY<DOUBLE>, target DOUBLE", "ARRAY<DOUBLE>", "zip_with(found, array_repeat(target / greatest(aggregate(found, 0D, (s, x) -> s + coalesce(x, 0D)), 1e-12D), size(found)), (x, r) -> log1p(x * r))"),
    "program_score": ("places ARRAY<INT>, found ARRAY<DOUBLE>, weights ARRAY<DOUBLE>", "DOUBLE", "coalesce(aggregate(zip_with(places, found, (p, x) -> x * try_element_at(weights, p + 1)), 0D, (s, y) -> s + coalesce(y, 0D)), 0D)"),
    "state_shares": ("usages ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(usages, array_repeat(aggregate(usages, 0D, (s, x) -> s + coalesce(x, 0D)), size(usages)), (u, t) -> if(t > 0, coalesce(u, 0D) / t, 0D))"),
}


def whole_cells(cohort: Cohort) -> DataFrame:
    """A row a cell with its values by gene id; one shuffle by cell."""
    maps = cohort.expr.groupBy(*prep.ON).agg(F.map_from_entries(F.collect_list(F.struct("gene_id", "value"))).alias("values"))
    return cohort.cells.join(maps, prep.ON, "left")


def placed_cells(cohort: Cohort) -> DataFrame:
    """A row a cell with the places of its values on the cohort's genes, and the values; one shuffle by cell."""
    arrays = cohort.expr.join(cohort.genes.select("gene_id", "gene_pos"), "gene_id").groupBy(*prep.ON).agg(F.collect_list(F.struct("gene_pos", "value")).alias("e"))
    arrays = arrays.select(*prep.ON, F.col("e.gene_pos").alias("places"), F.col("e.value").alias("found"))
    return cohort.cells.join(arrays, prep.ON, "left")


def placed_programs(cohort: Cohort, vocabulary: DataFrame) -> DataFrame:
    """A row a program with its weights along the cohort's genes."""
    full = stored_vocabulary(cohort.genes.select("gene_id", "gene_pos"), vocabulary).join(cohort.genes.select("gene_id", F.col("gene_pos").alias("at")), "gene_id")
    return full.groupBy("program_idx").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("w")).select("program_idx", F.col("w.weight").alias("weights"))


def _entries(batch: pa.RecordBatch, places: dict[str, int]) -> pd.DataFrame:
    """Cells of a batch with their non-zero values by place."""
    maps = batch.column(batch.schema.get_field_index("values"))
    flat = pa.table({"row": pa.nulls(0, pa.int64()), "key": pa.nulls(0, pa.string()), "value": pa.nulls(0, pa.float64())})
    if len(batch):
        lengths = np.diff(maps.offsets.to_numpy())
        # offsets of a null map span nothing that counts
        kept = np.where(maps.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
        rows = np.repeat(np.arange(len(batch)), lengths)
        first, last = maps.offsets[0].as_py(), maps.offsets[-1].as_py()
        flat = pa.table({"row": rows, "key": maps.keys.slice(first, last - first), "value": maps.items.slice(first, last - first)}).filter(pa.array(kept[rows] > 0))
    names, row = flat["key"].to_pandas(), flat["row"].to_numpy()
    at = names.map(places).to_numpy(dtype=float, na_value=np.nan)
    found = np.nan_to_num(flat["value"].to_numpy(zero_copy_only=False).astype(float), nan=0.0)
    use = ~np.isnan(at) & (found != 0)
    row, at, found = row[use], at[use].astype(np.int32), found[use]
    cuts = np.searchsorted(row, np.arange(1, len(batch)))
    text = lambda c: batch.column(batch.schema.get_field_index(c)).to_pandas()
    return pd.DataFrame({"sample_id": text("sample_id"), "cell_id": text("cell_id"), "places": np.split(at, cuts)[: len(batch)], "found": np.split(found, cuts)[: len(batch)]})


def register(spark: SparkSession, vocabulary: DataFrame, method: str = "nnls", name: str = "project_cells", **options) -> None:
    """Register ``name``, the projection of a table of whole cells on a frozen vocabulary, and the scalar functions.

    Cells are solved a batch at a time in whatever tasks they come in: nothing
    is shuffled unless the query asks for it. The vocabulary is small and
    travels with the function.
    """
    if method not in PER_CELL:
        raise ProjectionError(f"{method} learns from all cells; SQL can call {', '.join(PER_CELL)}")
    genes, basis = projection.basis_of(vocabulary)
    if not genes:
        raise ProjectionError("the vocabulary has no gene")
    places = {g: i for i, g in enumerate(genes)}
    run = projection.batch_projector(projection.PROJECTORS[method](**options), len(genes), basis)
    schema = pa.schema([("sample_id", pa.string()), ("cell_id", pa.string()), *[(c, pa.list_(pa.float64())) for c in ("usages", "states")], *[(c, pa.float64()) for c in ("projection_error", "relative_error", "observed_coverage")], ("uncertainty", pa.list_(pa.float64()))])

    class ProjectCells:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            step = max(1, ELEMENTS // len(genes))
            for first in range(0, batch.num_rows, step):
                for states in run(iter([_entries(batch.slice(first, step), places)])):
                    yield pa.Table.from_pandas(states, schema, preserve_index=False)

    spark.udtf.register(name, F.arrow_udtf(ProjectCells, returnType=projection.STATES))
    for scalar, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {scalar}({parameters}) RETURNS {result} RETURN {body}")
