"""A frozen vocabulary on a stream of values: windowed scores, and states of whole cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlens.errors import ProjectionError
from cohortlens.operators import projection
from cohortlens.schema import Cohort

#: Solvers whose result for a cell depends on that cell alone, so that batches don't matter.
PER_CELL = ("nnls", "regularized_nnls", "simplex", "poisson", "negative_binomial", "variational")


def scored_stream(values: DataFrame, vocabulary: DataFrame, keys: tuple[str, ...] = ("sample_id", "cell_id"), time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Direct scores of each cell and program by event-time window; ``values`` may be a stream.

    The vocabulary is static and joined as the optimiser likes; the windowed
    sum is the only state, dropped behind the watermark.
    """
    joined = values.withWatermark(time_col, late).join(vocabulary.select("program_idx", "gene_id", "weight"), "gene_id")
    summed = joined.groupBy(F.window(time_col, window).alias("w"), *keys, "program_idx").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    return summed.select(F.col("w.start").alias("window_start"), *keys, "program_idx", "score")


def _cells(rows: DataFrame, genes: DataFrame) -> Cohort:
    """Rows of whole cells (sample_id, cell_id, values: gene id -> value) as a cohort."""
    on = ["sample_id", "cell_id"]
    entries = rows.select(*on, F.explode("values").alias("gene_id", "value")).where("value <> 0")
    cells = rows.select(*on, F.lit(0).cast("long").alias("cell_pos"), F.lit(None).cast("string").alias("lineage"))
    return Cohort(cells, genes, entries.select(*on, "gene_id", F.col("value").cast("double").alias("value")))


def project_batch(rows: DataFrame, vocabulary: DataFrame, method: str = "nnls", **options) -> DataFrame:
    """States of the cells of one batch on a frozen vocabulary; a cell given twice counts once."""
    if method not in PER_CELL:
        raise ProjectionError(f"{method} learns from all cells; of a stream, {', '.join(PER_CELL)} can be projected")
    genes = vocabulary.select("gene_id", "gene_pos").distinct()
    return projection.project(_cells(rows.dropDuplicates(["sample_id", "cell_id"]), genes), vocabulary, method, allow_empty=True, **options)


def project_stream(cells: DataFrame, vocabulary: DataFrame, path: str, checkpoint: str, method: str = "nnls", trigger: dict | None = None, **options) -> StreamingQuery:
    """Project a stream of whole cells (sample_id, cell_id, values) into the folder ``path``.

    Each batch writes the folder of its own number, replacing what an attempt
    before a restart left there, so after any number of restarts from
    ``checkpoint`` every batch is there once. ``projected`` reads the result.
    """

    def write(rows: DataFrame, number: int) -> None:
        project_batch(rows, vocabulary, method, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def projected(spark: SparkSession, path: str) -> DataFrame:
    """The states that ``project_stream`` has written; a cell that came in several batches has its last state."""
    rows = spark.read.schema(f"{projection.STATES}, batch long").parquet(path)
    last = rows.groupBy("sample_id", "cell_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["sample_id", "cell_id", "batch"], "left_semi").drop("batch")
