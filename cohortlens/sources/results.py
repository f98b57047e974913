"""A store of per-sample results that grows and changes sample by sample.

Tables lie in ``tables/<name>/version=<v>/sample_id=<s>``; each addition writes a
version of its own, and a manifest, a small file with a number, says which
version of each sample counts. It is written last and then renamed, so what
fails before leaves every earlier sample as it was. One writer at a time: a
manifest of the next number that is there already raises.

Edge cases: sample ids are trimmed; null and blank ones raise; a sample that is
there raises unless it is to be replaced, and then nothing is written; a store
without samples raises when it is loaded; results without cells raise.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import __version__
from cohortlens.errors import InputError
from cohortlens.sources.atlas import trimmed

SCHEMA_VERSION = 1
KIND = "program store"
#: Tables of a result. Values of cells and genes aren't among them: a store holds results, not the data.
TABLES = ("programs", "usages", "stability", "diagnostics")
REQUIRED = ("programs", "usages")
#: Rows of a sample's cells that are written by one task.
ROWS = 2_000_000
#: Settings that results name, and all results of a store share.
AGREE = ("method", "preprocessing", "n_repeats")


class _Files:
    """The few files of a store that aren't tables, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, top: str):
        self.jvm, self.top = spark.sparkContext._jvm, top.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A whole file or none; one that is there raises."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        if self.fs.exists(self.path(name)) or not self.fs.rename(draft, self.path(name)):
            self.fs.delete(draft, False)
            raise InputError(f"{self.top}: another writer has published {name}")


def _manifest(files: _Files) -> tuple[int, dict]:
    """Number and content of the last manifest; (0, an empty one) where there is none."""
    names = [n for n in files.names("manifests") if n.endswith(".json")]
    if not names:
        return 0, {"schema_version": SCHEMA_VERSION, "artifact": KIND, "samples": {}, "schemas": {}, "parameters": {}}
    found = json.loads(files.read(f"manifests/{names[-1]}"))
    if found.get("artifact") != KIND or found.get("schema_version") != SCHEMA_VERSION:
        raise InputError(f"{files.top} holds {found.get('artifact')} of schema {found.get('schema_version')}, not {KIND} of schema {SCHEMA_VERSION}")
    return int(names[-1].removesuffix(".json")), found


def is_store(spark: SparkSession, path: str) -> bool:
    return bool(_Files(spark, path).names("manifests"))


def sample_ids(spark: SparkSession, path: str) -> list[str]:
    """Sorted ids of the samples that a store holds."""
    return sorted(_manifest(_Files(spark, path))[1]["samples"])


def _filled(rows: DataFrame, item: str, checks: dict[str, F.Column]) -> DataFrame:
    """By sample: items, the least and most programs and rows of one, and the most of each check.

    An item meets a few programs, so the set of an item's programs is small.
    """
    each = rows.groupBy("sample_id", item).agg(F.count("*").alias("rows"), F.size(F.collect_set("program_idx")).alias("programs"), *[F.max(c.cast("int")).alias(k) for k, c in checks.items()], F.min("program_idx").alias("first"), F.max("program_idx").alias("last"))
    most = [F.max(k).alias(k) for k in checks]
    return each.groupBy("sample_id").agg(F.count("*").alias("items"), F.max("rows").alias("rows"), F.min("programs").alias("least"), F.max("programs").alias("most"), F.min("first").alias("first"), F.max("last").alias("last"), *most)


def _odd(value: F.Column) -> F.Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)


def summaries(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Sample -> numbers of its cells, genes and programs, of results that are checked: the first fault raises.

    Every gene and every cell has each program once, all with finite weights
    that aren't negative, a gene has one place, and no program is empty.
    """
    programs, usages = tables["programs"], tables["usages"]
    places = programs.groupBy("sample_id", "gene_id").agg((F.min("gene_pos").eqNullSafe(F.max("gene_pos"))).alias("same")).where("not same").select("sample_id").distinct().withColumn("moved", F.lit(True))
    genes = _filled(programs, "gene_id", {"odd": _odd(F.col("weight"))})
    cells = _filled(usages, "cell_id", {"odd": _odd(F.col("usage"))})
    empty = programs.groupBy("sample_id", "program_idx").agg(F.max("weight").alias("w")).groupBy("sample_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(~(F.col("w") > 0), F.col("program_idx")))).alias("empty"))
    on = lambda df, p: df.select("sample_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "sample_id"])
    rows = on(genes, "g").join(on(cells, "c"), "sample_id", "full").join(empty, "sample_id", "left").join(places, "sample_id", "left").orderBy("sample_id")
    out = {}
    for r in rows.collect():  # a row a sample
        s = r["sample_id"]
        for wrong, said in (
            (s is None or not s.strip(), "every row needs a sample id"),
            (r["g_items"] is None, f"{s} has usages, but no programs"),
            (r["c_items"] is None, f"{s} has programs, but no cells"),
            (r["g_rows"] and r["g_rows"] > r["g_most"], f"{s}: a gene of a program occurs twice"),
            (r["c_rows"] and r["c_rows"] > r["c_most"], f"{s}: cell ids have to be unique"),
            (r["g_least"] != r["n"] or r["moved"], f"{s}: programs are on different genes"),
            (r["c_least"] != r["n"] or r["c_most"] != r["n"] or (r["c_first"], r["c_last"]) != (r["g_first"], r["g_last"]), f"{s}: usages aren't of its {r['n']} programs"),
            (r["g_odd"], f"{s}: weights have to be finite and not negative"),
            (r["c_odd"], f"{s}: usages have to be finite and not negative"),
            (r["empty"], f"{s}: empty programs at indices {r['empty']}"),
        ):
            if wrong:
                raise InputError(said)
        out[s] = {"n_cells": r["c_items"], "n_genes": r["g_items"], "n_programs": r["n"]}
    if not out:
        raise InputError("there are no results")
    return out


def _same_settings(stored: dict, given: dict) -> None:
    if lost := [k for k in AGREE if k not in given]:
        raise InputError(f"results have to name their {', '.join(lost)}")
    if unlike := [k for k in AGREE if stored and str(stored.get(k)) != str(given[k])]:
        raise InputError(f"results differ in {', '.join(unlike)} from those of the store")


def _dealt(table: DataFrame, about: dict[str, dict]) -> DataFrame:
    """Rows by sample, so that a sample has few files; cells of a large one are dealt to several tasks."""
    if "cell_id" not in table.columns:
        return table.repartition("sample_id")
    parts = [(s, 1 + a["n_cells"] * a["n_programs"] // ROWS) for s, a in about.items()]
    rows = table.join(table.sparkSession.createDataFrame(parts, "sample_id string, _parts long"), "sample_id")
    return rows.repartition("sample_id", F.pmod(F.xxhash64("cell_id"), "_parts")).drop("_parts")


def parameters_of(spark: SparkSession, path: str) -> dict:
    """The settings that the results of a store share; none where it has no results."""
    return _manifest(_Files(spark, path))[1]["parameters"]


def add(spark: SparkSession, path: str, tables: dict[str, DataFrame], parameters: dict, overwrite: bool = False) -> list[str]:
    """Add the samples of ``tables`` and return their ids; ones that the store has raise unless they are to be replaced."""
    if lost := set(REQUIRED) - set(tables):
        raise InputError(f"results lack {sorted(lost)}")
    if other := set(tables) - set(TABLES):
        raise InputError(f"a store holds no expression matrix or other tables: {sorted(other)}")
    files = _Files(spark, path)
    number, manifest = _manifest(files)
    _same_settings(manifest["parameters"], parameters)
    tables = {k: t.withColumn("sample_id", trimmed(F.col("sample_id"))) for k, t in tables.items()}
    found = summaries(tables)
    if clash := sorted(set(found) & set(manifest["samples"])):
        if not overwrite:
            raise InputError(f"samples {clash} are in the store already")
    version = uuid.uuid4().hex
    schemas = dict(manifest["schemas"])
    for name, table in tables.items():
        own = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.drop("sample_id").schema]
        if sorted(schemas.setdefault(name, own)) != sorted(own):
            raise InputError(f"{name} has other columns than in the store")
        _dealt(table, found).write.partitionBy("sample_id").parquet(f"{files.top}/tables/{name}/version={version}")
    samples = manifest["samples"] | {s: about | {"version": version, "tables": sorted(tables)} for s, about in found.items()}
    done = {"schema_version": SCHEMA_VERSION, "artifact": KIND, "version": __version__, "samples": samples, "schemas": schemas, "parameters": parameters}
    files.publish(f"manifests/{number + 1:09d}.json", json.dumps(done, sort_keys=True))
    return sorted(found)


def load(spark: SparkSession, path: str, samples: Iterable[str] | None = None, check: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """Tables of all samples of a store (or the named ones) and the settings that they share.

    With ``check`` the rows are checked anew and counted against the manifest.
    """
    manifest = _manifest(_Files(spark, path))[1]
    wanted = sorted(manifest["samples"]) if samples is None else sorted({s.strip() for s in samples})
    if unknown := set(wanted) - set(manifest["samples"]):
        raise InputError(f"{path} has no samples {sorted(unknown)}")
    if not wanted:
        raise InputError(f"{path} holds no results")
    about = {s: manifest["samples"][s] for s in wanted}
    tables = {}
    for name, schema in manifest["schemas"].items():
        have = [(s, a["version"]) for s, a in about.items() if name in a["tables"]]
        full = ", ".join([*schema, "version string", "sample_id string"])
        if not have:
            rows = spark.createDataFrame([], full)
        else:
            # both columns name folders, so both filters prune them; the join leaves out replaced versions
            rows = spark.read.schema(full).parquet(f"{path.rstrip('/')}/tables/{name}").where(F.col("version").isin(sorted({v for _, v in have})) & F.col("sample_id").isin([s for s, _ in have]))
            rows = rows.join(spark.createDataFrame(have, "sample_id string, version string"), ["sample_id", "version"], "left_semi")
        tables[name] = rows.select("sample_id", *[c for c in rows.columns if c not in ("sample_id", "version")])
    if check:
        sizes = ("n_cells", "n_genes", "n_programs")
        found = summaries(tables)
        if unlike := [s for s in wanted if found.get(s) != {k: about[s][k] for k in sizes}]:
            raise InputError(f"{path}: rows of {unlike} aren't those that were stored")
    return tables, manifest["parameters"]


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete versions and manifests that no longer count (of replaced samples, and what failed additions left); returns the number of versions."""
    files = _Files(spark, path)
    number, manifest = _manifest(files)
    live = {f"version={a['version']}" for a in manifest["samples"].values()}
    gone = set()
    for name in files.names("tables"):
        for version in set(files.names(f"tables/{name}")) - live:
            files.fs.delete(files.path(f"tables/{name}/{version}"), True)
            gone.add(version)
    for old in files.names("manifests"):
        if old < f"{number:09d}.json":
            files.fs.delete(files.path(f"manifests/{old}"), False)
    files.fs.delete(files.path("drafts"), True)
    return len(gone)
