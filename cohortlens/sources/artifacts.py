"""Saving and loading results as Parquet tables beside one JSON table of metadata."""

from __future__ import annotations

import json
import platform

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import __version__
from cohortlens.errors import InputError, StateError

SCHEMA_VERSION = 1


def save(tables: dict[str, DataFrame], path: str, artifact: str, parameters: dict | None = None, overwrite: bool = False) -> None:
    """Write each table below ``path``; an existing artifact is refused unless overwritten. No time stamps are stored.

    Metadata come last, so a save that failed can't be loaded.
    """
    mode = "overwrite" if overwrite else "error"
    spark = next(iter(tables.values())).sparkSession

    def described(as_: dict) -> None:
        spark.createDataFrame([(json.dumps(as_, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")

    if overwrite:
        described({"schema_version": SCHEMA_VERSION, "artifact": "incomplete"})
    for name, df in tables.items():
        keys = [c for c in ("sample_id", "cell_id", "program_idx", "gene_pos") if c in df.columns]
        (df.sortWithinPartitions(*keys) if keys else df).write.mode(mode).parquet(f"{path}/{name}")
    meta = {"schema_version": SCHEMA_VERSION, "artifact": artifact, "version": __version__, "tables": sorted(tables), "parameters": parameters or {}}
    described(meta)


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions of what results depend on."""
    return {"cohortlens": __version__, "spark": spark.version, "python": platform.python_version(), "numpy": np.__version__, "pandas": pd.__version__, "pyarrow": pa.__version__}


def save_run(spark: SparkSession, path: str, command: str, arguments: dict) -> None:
    """What was run last with ``path`` for its output, and in which environment, as a line of JSON in ``run.json``."""
    text = json.dumps({"schema_version": SCHEMA_VERSION, "command": command, "arguments": arguments, "environment": environment(spark)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/run.json")


def load_run(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/run.json").first()[0])


def load(spark: SparkSession, path: str, artifact: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and parameters of a saved artifact of the given kind."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["schema_version"] != SCHEMA_VERSION or meta["artifact"] != artifact:
        raise InputError(f"{path} holds {meta['artifact']} of schema {meta['schema_version']}, not {artifact}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}, meta["parameters"]


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders right below a path, by Spark's own listing; none if the path isn't there."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(top) if f.isDirectory()) if fs.exists(top) else []


def is_artifact(spark: SparkSession, path: str) -> bool:
    return any(f.rsplit("/", 1)[-1] == "meta" for f in _folders(spark, path))


def load_each(spark: SparkSession, path: str, artifact: str) -> dict[str, tuple[dict[str, DataFrame], dict]]:
    """Folder name -> tables and parameters of an artifact, or of every one right below ``path`` (not deeper)."""
    if is_artifact(spark, path):
        return {path.rstrip("/").rsplit("/", 1)[-1]: load(spark, path, artifact)}
    found = {f.rsplit("/", 1)[-1]: load(spark, f, artifact) for f in _folders(spark, path) if is_artifact(spark, f)}
    if not found:
        raise InputError(f"no {artifact} below {path}")
    return found


def report(df: DataFrame, path: str, sep: str = "\t", overwrite: bool = False) -> None:
    """A small table as delimited text with a header, arrays as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]
    df.select(*flat).coalesce(1).write.mode("overwrite" if overwrite else "error").option("header", True).option("sep", sep).csv(path)


def _one_row_a_cell(rows: DataFrame, cells: DataFrame, kind: str) -> None:
    """Raise unless ``rows`` have each of ``cells`` once and no other; counts of both are compared by cell."""
    keys = ["sample_id", "cell_id"]
    both = rows.select(*keys, F.lit(1).alias("_own"), F.lit(0).alias("_all")).unionByName(cells.select(*keys, F.lit(0).alias("_own"), F.lit(1).alias("_all")))
    odd = both.groupBy(*keys).agg(F.sum("_own").alias("_own"), F.sum("_all").alias("_all")).where("_own <> 1 OR _all <> 1").first()
    if odd:
        raise StateError(f"{kind} need one row a cell: {odd['sample_id']}/{odd['cell_id']} has {odd['_own']} for {odd['_all']} in the cohort")


def save_values(rows: DataFrame, path: str, kind: str, parameters: dict | None = None, overwrite: bool = False, cells: DataFrame | None = None) -> None:
    """Activities or coordinates, an array a cell (sample_id, cell_id and the array); values that aren't finite raise.

    With the ``cells`` of a cohort, every one of them has to have one row, and arrays one length.
    """
    column = next(c for c in rows.columns if c not in ("sample_id", "cell_id"))
    if cells is not None:
        _one_row_a_cell(rows, cells, kind)
        sizes = rows.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
        if sizes["a"] != sizes["b"]:
            raise StateError(f"{kind} have {sizes['a']} to {sizes['b']} values a cell")
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size(column) < 1)
    if rows.where(F.coalesce(bad, F.lit(True))).limit(1).count():
        raise StateError(f"{kind} have values that aren't finite")
    save({"values": rows}, path, kind, parameters, overwrite)


def save_model(spark: SparkSession, model: dict[str, np.ndarray], path: str, kind: str, overwrite: bool = False) -> None:
    """Arrays of a fitted model (axes, scales, layers), a row each."""
    rows = [(k, list(map(int, v.shape)), np.asarray(v, float).ravel().tolist()) for k, v in model.items()]
    save({"arrays": spark.createDataFrame(rows, "name string, shape array<int>, x array<double>")}, path, kind, None, overwrite)


def load_model(spark: SparkSession, path: str, kind: str) -> dict[str, np.ndarray]:
    """A model is small by its kind (a vocabulary's size), so it is read whole."""
    return {r["name"]: np.array(r["x"]).reshape(r["shape"]) for r in load(spark, path, kind)[0]["arrays"].collect()}


def stored_vocabulary(genes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The vocabulary on a whole gene axis: genes outside it weigh 0."""
    programs = sorted(r[0] for r in vocabulary.select("program_idx").distinct().collect())
    if not programs:
        return vocabulary.select("program_idx", "gene_id", "weight")
    full = genes.withColumn("program_idx", F.explode(F.array(*[F.lit(p) for p in programs])))
    joined = full.join(vocabulary.select("program_idx", "gene_id", "weight"), ["program_idx", "gene_id"], "left")
    return joined.select("program_idx", "gene_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))
