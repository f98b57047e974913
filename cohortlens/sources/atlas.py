"""Cohorts from relational tables and from rows of one's own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.errors import SampleError
from cohortlens.schema import CELLS, EXPR, GENES, Cohort
from cohortlens.storage import stored


def trimmed(column) -> F.Column:
    return F.regexp_replace(column.cast("string"), r"^\s+|\s+$", "")


def orders_atlas(spark: SparkSession, sf_dir: str, gene: str = "p_brand") -> Cohort:
    """Customers as cells, brands as genes, ordered quantity as value; regions are samples, market segments lineages.

    The joins run once; what follows reads their stored result.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    values = lines.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("part").select("p_partkey", F.col(gene).cast("string").alias("gene_id")), F.col("l_partkey") == F.col("p_partkey"))
    summed = values.groupBy(F.col("o_custkey").alias("cell_pos"), "gene_id").agg(F.sum("l_quantity").alias("value"))
    who = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    who = who.select(F.col("n_regionkey").cast("string").alias("sample_id"), F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_custkey").alias("cell_pos"), F.col("c_mktsegment").alias("lineage"))
    wide = stored(who.join(summed, "cell_pos").select("sample_id", "cell_id", "cell_pos", "lineage", "gene_id", F.col("value").cast("double").alias("value")))
    cells = stored(wide.select("sample_id", "cell_id", "cell_pos", "lineage").distinct())
    genes = stored(gene_axis(read("part").select(F.col(gene).cast("string").alias("gene_id"))))
    return Cohort(cells, genes, wide.where("value <> 0").select("sample_id", "cell_id", "gene_id", "value"))


def gene_axis(ids: DataFrame) -> DataFrame:
    """Distinct ids with positions in their order; the axis of genes is small."""
    return ids.distinct().select("gene_id", (F.row_number().over(Window.orderBy("gene_id")) - 1).alias("gene_pos"))


def from_rows(spark: SparkSession, cells: list[tuple], values: list[tuple], genes: list[str] | None = None) -> Cohort:
    """Small cohorts: cells (sample_id, cell_id, lineage), values (sample_id, cell_id, gene_id, value)."""
    table = spark.createDataFrame([(s, c, i, lineage) for i, (s, c, lineage) in enumerate(cells)], CELLS)
    genes = genes or sorted({v[2] for v in values})
    axis = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], GENES)
    return Cohort(table, axis, spark.createDataFrame([(s, c, g, float(v)) for s, c, g, v in values if v], EXPR))


def samples_from_atlas(cohort: Cohort, min_samples: int = 2) -> list[str]:
    """Sorted sample ids (one row a sample, all of them); fewer than ``min_samples`` raise."""
    ids = [r[0] for r in cohort.cells.select(trimmed(F.col("sample_id"))).distinct().collect()]
    if len(ids) < min_samples:
        raise SampleError(f"{min_samples} samples are needed; there are {len(ids)}")
    return sorted(ids)


def named(cohort: Cohort, name: str) -> Cohort:
    """A cohort of one sample under another id."""
    if not name.strip():
        raise SampleError("a sample id can't be blank")
    name_it = {"sample_id": F.lit(name.strip())}
    return cohort.with_(cells=cohort.cells.withColumns(name_it), **cohort._each(lambda x: x.withColumns(name_it)))


def relabelled(cohort: Cohort, key: str = "sample_id") -> Cohort:
    """The cohort with its samples named by a column of ``cells``, white space around names trimmed; a cell without a name raises.

    Names that differ by that white space only are one sample, in all tables.
    """
    if key not in cohort.cells.columns:
        raise SampleError(f"cells have no column {key}")
    label = trimmed(F.col(key))
    label = F.when(F.coalesce(label, F.lit("")) == "", F.raise_error(F.lit(f"a cell has no {key}")).cast("string")).otherwise(label)
    on = ["sample_id", "cell_id"]
    names = cohort.cells.select(*on, label.alias("_name"))
    cells = cohort.cells.withColumn("sample_id", label) if key == "sample_id" else cohort.cells.withColumn("_name", label).drop("sample_id").withColumnRenamed("_name", "sample_id")
    columns = ["sample_id", *[c for c in cohort.cells.columns if c != "sample_id"]]
    if key == "sample_id":
        return cohort.with_(cells=cells.select(columns), **cohort._each(lambda x: x.withColumn("sample_id", trimmed(F.col("sample_id")))))
    return cohort.with_(cells=cells.select(columns), **cohort._each(lambda x: x.join(names, on).drop("sample_id").withColumnRenamed("_name", "sample_id").select(x.columns)))


def samples_by_key(sources: Sequence[Cohort], key: str) -> Cohort:
    """Union of cohorts of one or more samples each, every one named by the column ``key`` of its own cells; a name in two sources raises."""
    if not key.strip():
        raise SampleError("the name of a column can't be blank")
    if not sources:
        raise SampleError("at least one source is needed")
    parts = [relabelled(one, key.strip()) for one in sources]
    owners = reduce(DataFrame.unionByName, [p.cells.select("sample_id").withColumn("source", F.lit(i)) for i, p in enumerate(parts)])
    counts = owners.groupBy("sample_id").agg(F.countDistinct("source").alias("n"))
    if clash := sorted(r[0] for r in counts.where("n > 1").limit(20).collect()):
        raise SampleError(f"sample ids have to be different: {clash} are in several sources")
    return _united(parts)


def samples_from_sources(sources: dict[str, Cohort], single: bool = False) -> Cohort:
    """Union of single-sample cohorts under their given ids, on the genes that all of them have.

    A source of several samples raises, as it would be pooled (``samples_by_key``
    splits it); ``single`` says that the caller knows each to be one.
    """
    if not sources:
        raise SampleError("at least one source is needed")
    labelled = {}
    for name, one in sources.items():
        key = name.strip()
        if key in labelled:
            raise SampleError(f"sample ids have to be different: {name!r}")
        if not single and one.cells.select(trimmed(F.col("sample_id"))).distinct().limit(2).count() > 1:
            raise SampleError(f"{name!r} holds several samples; name them by a column")
        labelled[key] = named(one, key)
    return _united(list(labelled.values()))


def _united(parts: list[Cohort]) -> Cohort:
    """Cells of all parts on the genes that all of them have, in the order of the first one."""
    common = lambda x: [c for c in x[0].columns if all(c in p.columns for p in x)]
    cells = reduce(DataFrame.unionByName, [p.cells.select(common([q.cells for q in parts])) for p in parts])
    expr = reduce(DataFrame.unionByName, [p.expr for p in parts])
    every = reduce(DataFrame.unionByName, [p.genes.select("gene_id") for p in parts])
    shared = every.groupBy("gene_id").count().where(F.col("count") == len(parts)).select("gene_id")
    genes = parts[0].genes.join(shared, "gene_id", "left_semi")
    more = [c for c in genes.columns if c not in ("gene_id", "gene_pos")]
    genes = genes.select("gene_id", (F.row_number().over(Window.orderBy("gene_pos")) - 1).alias("gene_pos"), *more)
    return Cohort(cells, genes, expr.join(shared, "gene_id", "left_semi"))
