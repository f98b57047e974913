"""10x-style matrix folders and tar archives: prefixed or plain triples of matrix, barcodes and features, gzipped or not.

All samples are read by one plan: the matrices by one scan, the side tables by
one each, whatever the number of samples. A line is known by its file, the
block of the file that it lies in, and its place in the block.
"""

from __future__ import annotations

import gzip
import io
import itertools
import re
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.errors import DatasetError
from cohortlens.operators import prep
from cohortlens.schema import Cohort
from cohortlens.sources.ranges import opened
from cohortlens.storage import stored

NAME = re.compile(r"(?P<prefix>.*?)(?P<kind>matrix|barcodes|features|genes)\.(?:mtx|tsv|txt)(?:\.gz)?$")
#: Lines that a task takes out of an archive at a time.
LINES = 100_000
#: Lines of the named files: (path, block, n, line), in order of block and n.
Read = Callable[[list[str]], DataFrame]


def _listed(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path -> name, as Spark writes it in a scan, of the files in a folder, by Spark's own listing, so any store will do."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)]
    return {f.toString(): f.toUri().getRawPath().rsplit("/", 1)[-1] for f in found}


def sample_name(prefix: str) -> str:
    """The accession that a prefix starts with, else the prefix itself."""
    found = re.match(r"GSM\d+", prefix)
    return found[0] if found else prefix.strip("_-. ") or "sample"


def triples(names: list[str]) -> dict[str, dict[str, str]]:
    """Sample name -> {matrix, barcodes, features} among file names; two triples of one sample raise."""
    found: dict[str, dict[str, str]] = {}
    prefixes: dict[str, str] = {}
    for path in sorted(names):
        if m := NAME.match(path.rsplit("/", 1)[-1]):
            sample = sample_name(m["prefix"])
            if prefixes.setdefault(sample, m["prefix"]) != m["prefix"]:
                raise DatasetError(f"{prefixes[sample]} and {m['prefix']} are both sample {sample}")
            kind = "features" if m["kind"] == "genes" else m["kind"]
            if kind in found.setdefault(sample, {}):
                raise DatasetError(f"{sample} has {kind} twice")
            found[sample][kind] = path
    whole = {k: v for k, v in found.items() if len(v) == 3}
    if not whole:
        raise DatasetError("no matrix with barcodes and features")
    return whole


def _folder(spark: SparkSession, path: str) -> tuple[list[str], Read]:
    """Files of a folder; plain ones are split into blocks, gzipped ones are a block each."""
    files = _listed(spark, path)

    def read(paths: list[str]) -> DataFrame:
        line = F.regexp_replace("value", r"\r$", "").alias("line")
        rows = spark.read.text(paths).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), line)
        return rows.join(spark.createDataFrame([(files[p], p) for p in paths], "name string, path string"), "name").drop("name")

    return list(files), read


def _member_lines(name: str, raw: io.BufferedIOBase) -> Iterator[pd.DataFrame]:
    text = io.TextIOWrapper(gzip.open(raw) if name.endswith(".gz") else raw, "utf-8")
    for first in itertools.count(0, LINES):
        lines = list(itertools.islice(text, LINES))
        if not lines:
            return
        yield pd.DataFrame({"path": name, "block": 0, "n": range(first, first + len(lines)), "line": [x.rstrip("\r\n") for x in lines]})


def _archive(spark: SparkSession, path: str) -> tuple[list[str], Read]:
    """Members of a tar archive as a stored table: of a plain archive each is a task, a gzipped one is read by one task, as a stream."""
    wanted = lambda m: m.isfile() and bool(NAME.match(m.name.rsplit("/", 1)[-1]))
    schema = "path string, block long, n long, line string"
    if path.endswith(".tar"):
        with opened(path) as file, tarfile.open(fileobj=file, mode="r:") as archive:
            members = [(m.name, m.offset_data, m.size) for m in archive if wanted(m)]  # headers only are read

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, start, size in batch.itertuples(index=False):
                    with opened(path) as file:
                        file.seek(start)
                        yield from _member_lines(name, io.BufferedReader(_Part(file, size)))

        names = [m[0] for m in members]
        rows = spark.createDataFrame(members, "name string, start long, size long").repartitionByRange(max(len(members), 1), "start")
    else:

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _ in batches:
                with opened(path) as file, tarfile.open(fileobj=file, mode="r:gz") as archive:
                    for member in archive:
                        if wanted(member):
                            yield from _member_lines(member.name, archive.extractfile(member))

        names, rows = None, spark.range(1, numPartitions=1)
    lines = stored(rows.mapInPandas(one, schema))
    names = names if names is not None else [r[0] for r in lines.select("path").distinct().collect()]
    return names, lambda paths: lines.where(F.col("path").isin(paths))


class _Part(io.RawIOBase):
    """The next ``size`` bytes of a file."""

    def __init__(self, file, size: int):
        self.file, self.left = file, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _named(read: Read, found: dict[str, dict[str, str]], kind: str) -> DataFrame:
    """Lines of one kind of file of all samples, with their sample_id."""
    paths = {files[kind]: sample for sample, files in found.items()}
    lines = read(list(paths))
    return lines.join(lines.sparkSession.createDataFrame(list(paths.items()), "path string, sample_id string"), "path")


def _numbered(lines: DataFrame, column: str, least: int) -> DataFrame:
    """Lines of a side table (a row a gene or a cell) with their numbers from 1 in each sample; each needs ``least`` columns.

    A block's lines are numbered by themselves, and go on from the counts of the blocks before.
    """
    parts = F.split("line", "\t")
    checked = F.when(F.size(parts) >= least, parts[0]).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {least} columns: "), "line")).cast("string"))
    symbol = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)))
    block = ["sample_id", "block"]
    rows = stored(lines.where("line <> ''").select(*block, "n", checked.alias(column), symbol.alias("symbol")))
    before = F.sum("count").over(Window.partitionBy("sample_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*block).count().select(*block, F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("n"))
    return stored(rows.withColumn("place", place).join(counts, block).select("sample_id", (F.col("before") + F.col("place")).alias("n"), column, "symbol"))


def _entries(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.where("line not like '\\%%' and trim(line) <> ''").select("sample_id", "block", "n", parts.alias("p"))
    return stored(rows.select("sample_id", "block", "n", F.col("p")[0].cast("long").alias("g"), F.col("p")[1].cast("long").alias("c"), F.col("p")[2].cast("double").alias("value")))


def _checked_heads(entries: DataFrame, features: DataFrame, barcodes: DataFrame, samples: list[str]) -> DataFrame:
    """The first entry of each matrix, its shape; raises where names repeat in a sample or the shape isn't that of the side tables."""
    for side, column in ((barcodes, "barcode"), (features, "gene_id")):
        if twice := side.groupBy("sample_id", column).count().where("count > 1").first():
            raise DatasetError(f"{twice['sample_id']}: {column} {twice[column]} occurs twice")
    heads = stored(entries.groupBy("sample_id").agg(F.min(F.struct("block", "n", "g", "c")).alias("h")).select("sample_id", "h.*"))
    all_ = entries.sparkSession.createDataFrame([(s,) for s in samples], "sample_id string").join(heads, "sample_id", "left")
    for side, name in ((features, "n_genes"), (barcodes, "n_cells")):
        all_ = all_.join(side.groupBy("sample_id").agg(F.count("*").alias(name)), "sample_id", "left")
    same = F.coalesce((F.col("g") == F.col("n_genes")) & (F.col("c") == F.col("n_cells")), F.lit(False))
    if bad := all_.where(~same).first():
        raise DatasetError(f"{bad['sample_id']}: the matrix is {(bad['g'], bad['c'])}, its side tables give {(bad['n_genes'], bad['n_cells'])}")
    return heads


def read_10x_samples(spark: SparkSession, path: str, sample_ids: list[str] | None = None, min_counts: float = 0, min_genes: int = 0, max_cells_per_sample: int | None = None) -> Cohort:
    """All samples of a folder or a tar archive (or the named ones), on the features that they share, in the first one's order.

    Cells are named sample:barcode; explicit zeros go; indices count from 1.
    Cells are checked, and the first N taken, within each sample and on all
    its features. The number of jobs doesn't depend on the number of samples.
    """
    names, read = (_archive if re.search(r"\.tar(\.gz)?$|\.tgz$", path) else _folder)(spark, path)
    found = triples(names)
    if sample_ids and (missing := set(sample_ids) - set(found)):
        raise DatasetError(f"no samples {sorted(missing)} in {path}")
    found = {k: v for k, v in sorted(found.items()) if not sample_ids or k in sample_ids}
    features = _numbered(_named(read, found, "features"), "gene_id", 2)
    barcodes = _numbered(_named(read, found, "barcodes"), "barcode", 1)
    entries = _entries(_named(read, found, "matrix"))
    heads = _checked_heads(entries, features, barcodes, list(found))
    rows = entries.join(heads.select("sample_id", "block", "n"), ["sample_id", "block", "n"], "left_anti").where("value <> 0")
    rows = rows.join(features.select("sample_id", F.col("n").alias("g"), "gene_id"), ["sample_id", "g"])
    rows = rows.join(barcodes.select("sample_id", F.col("n").alias("c"), "barcode"), ["sample_id", "c"])
    cell = F.concat_ws(":", "sample_id", "barcode").alias("cell_id")
    cells = barcodes.select("sample_id", cell, (F.col("n") - 1).alias("cell_pos"), F.lit(None).cast("string").alias("lineage"))
    shared = features.groupBy("gene_id").count().where(F.col("count") == len(found)).select("gene_id")
    axis = features.where(F.col("sample_id") == next(iter(found))).join(shared, "gene_id", "left_semi")
    genes = axis.select("gene_id", (F.row_number().over(Window.orderBy("n")) - 1).alias("gene_pos"), F.col("symbol").alias("gene_symbol"))
    cohort = Cohort(cells, genes, rows.select("sample_id", cell, "gene_id", "value"))
    if min_counts or min_genes or max_cells_per_sample is not None:
        cohort = prep.filtered_cells(cohort, min_counts, min_genes, max_cells_per_sample)
    return cohort.with_(expr=cohort.expr.join(shared, "gene_id", "left_semi").select("sample_id", "cell_id", "gene_id", "value"))
