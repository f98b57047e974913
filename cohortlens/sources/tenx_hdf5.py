"""10x HDF5 count matrices as a Spark data source: the values of one file are read by several tasks, each its chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortlens.errors import DatasetError
from cohortlens.functions import hdf5
from cohortlens.schema import Cohort
from cohortlens.sources.ranges import ranges
from cohortlens.storage import stored

#: Values of a task, rounded to whole chunks.
ELEMENTS = 1 << 22
SCHEMAS = {"entries": "cell_pos long, feature int, value double", "barcodes": "cell_pos long, barcode string", "features": "feature int, gene_id string, gene_symbol string, feature_type string"}
REQUIRED = ("data", "indices", "indptr", "shape", "barcodes", "features")
KEPT = "Gene Expression"


def is_hdf5(path: str) -> bool:
    """Told by the first bytes (of the file, or behind a user block), whatever its name."""
    try:
        hdf5.File(ranges(path))
    except DatasetError:
        return False
    return True


class Matrix:
    """The arrays of a file's ``/matrix``, checked."""

    def __init__(self, path: str):
        self.file = hdf5.File(ranges(path))
        root = self.file.children(self.file.root) or {}
        group = self.file.children(root["matrix"]) if "matrix" in root else None
        if group is None:
            raise DatasetError(f"{path} has no group /matrix, so it isn't a 10x matrix")
        if missing := sorted(set(REQUIRED) - set(group)):
            raise DatasetError(f"{path}: /matrix lacks {missing}")
        features = self.file.children(group["features"])
        if features is None or not {"id", "name"} <= set(features):
            raise DatasetError(f"{path}: /matrix/features is incomplete")
        array = self.file.array
        self.data, self.indices, self.indptr, self.barcodes = (array(group[k]) for k in ("data", "indices", "indptr", "barcodes"))
        self.ids, self.symbols = array(features["id"]), array(features["name"])
        self.kinds = array(features["feature_type"]) if "feature_type" in features else None
        shape = tuple(int(x) for x in self.file.values(array(group["shape"])))
        if shape != (self.ids.length, self.barcodes.length) or self.indptr.length != shape[1] + 1 or self.indices.length != self.data.length:
            raise DatasetError(f"{path}: the matrix is {shape}, its annotations give {(self.ids.length, self.barcodes.length)}")


@dataclass
class Part(InputPartition):
    start: int
    stop: int

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, elements: int):
        self.path, self.table, self.elements = path, table, elements

    def partitions(self) -> list[Part]:
        m = Matrix(self.path)
        of = {"entries": m.data, "barcodes": m.barcodes, "features": m.ids}[self.table]
        step = max(1, self.elements)
        if of.chunk_length:
            step = -(-step // of.chunk_length) * of.chunk_length
        return [Part(a, min(of.length, a + step)) for a in range(0, of.length, step)] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        m = Matrix(self.path)
        places = np.arange(part.start, part.stop)
        if self.table == "entries":
            # a column of the file is a cell; empty ones share their start with the next
            cells = np.searchsorted(m.file.values(m.indptr).astype(np.int64), places, "right") - 1
            columns = [pa.array(cells), pa.array(m.file.values(m.indices, part.start, part.stop).astype(np.int32)), pa.array(m.file.values(m.data, part.start, part.stop).astype(np.float64))]
        elif self.table == "barcodes":
            columns = [pa.array(places), pa.array(m.file.strings(m.barcodes, part.start, part.stop), pa.string())]
        else:
            kinds = m.file.strings(m.kinds, part.start, part.stop) if m.kinds else [None] * len(places)
            columns = [pa.array(places.astype(np.int32)), *(pa.array(m.file.strings(x, part.start, part.stop), pa.string()) for x in (m.ids, m.symbols)), pa.array(kinds, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMAS[self.table].split(", ")])


class TenxHdf5(DataSource):
    """Options: ``path``, ``table`` (entries, barcodes or features) and ``elements`` (values a task)."""

    @classmethod
    def name(cls) -> str:
        return "tenx_hdf5"

    def _table(self) -> str:
        table = self.options.get("table", "entries")
        if table not in SCHEMAS:
            raise DatasetError(f"{table} isn't one of {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._table(), int(self.options.get("elements", ELEMENTS)))


def read_10x_hdf5(spark: SparkSession, path: str, sample_id: str | None = None, elements: int = ELEMENTS) -> Cohort:
    """The cells of one file as a sample named after it, on its ``Gene Expression`` features (on all, if it has no types).

    The counts are also the layer ``counts``; explicit zeros go.
    """
    spark.dataSource.register(TenxHdf5)
    load = lambda table: spark.read.format("tenx_hdf5").options(path=path, table=table, elements=elements).load()
    name = sample_id or re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
    features = stored(load("features").where(F.col("feature_type").isNull() | (F.col("feature_type") == KEPT)))
    barcodes = stored(load("barcodes"))
    if not features.limit(1).count():
        raise DatasetError(f"{path} has no {KEPT} features")
    for side, column in ((features, "gene_id"), (barcodes, "barcode")):
        if side.groupBy(column).count().where("count > 1").limit(1).count():
            raise DatasetError(f"{path}: a {column} occurs twice")
    sample = F.lit(name).alias("sample_id")
    cells = barcodes.select(sample, F.col("barcode").alias("cell_id"), "cell_pos", F.lit(None).cast("string").alias("lineage"))
    genes = features.select("gene_id", F.col("feature").alias("gene_pos"), "gene_symbol")
    values = load("entries").where("value <> 0").join(features.select("feature", "gene_id"), "feature").join(barcodes, "cell_pos")
    expr = stored(values.select(sample, F.col("barcode").alias("cell_id"), "gene_id", "value"))
    return Cohort(cells, genes, expr, {"counts": expr})
