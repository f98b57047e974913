"""What the training-data operators share: tables on the shared folder, words, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Largest table, in bytes, that an operator sends to every executor; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20
#: Characters of text that a Python task takes apart at a time.
PORTION = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset on
    a single machine (tests) a temporary folder is made and set.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: list[str] = []


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``stored`` wrote meanwhile; the result has to be written elsewhere by then."""
    first = len(_stored)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while len(_stored) > first:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stored.pop())
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table on the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read, not a rerun.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark ``df`` for a broadcast when its counted size allows, else leave the join to shuffle.

    ``df`` should be a stored table: it is counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one, ``_row``, so that added columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_evenly(df: DataFrame) -> DataFrame:
    """``df`` dealt anew only if it came in fewer tasks than the session has cores (one small file)."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


#: A group with more than one row in so many counts as hot, so there are fewer hot groups than that.
HOT_SHARE = 1000
HOT_ROWS = 1000


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group (a row for each, ``size`` its rows of at most ``total``); keys may not be null.

    Hot groups, fewer than ``HOT_SHARE``, are sent to all tasks, so none of
    them comes together in one; the others are joined as the optimiser likes.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    if total <= least:
        return rows.join(groups, keys)
    hot = groups.where(F.col(size) > least)
    if not hot.limit(1).count():
        return rows.join(groups, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= least), keys)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: one row (``node``, ``root``) per node that has an edge.

    ``root`` is the smallest node of the component. Alternates large-star and
    small-star steps, each a grouped minimum (combined on the map side) and a
    join that splits hubs; every round is written to the shared folder, so
    neither the lineage nor any task grows with the component. Loops and
    repeated edges do no harm.
    """
    left, right = F.col("u"), F.col("v")
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(left != right).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "edges")
    before, n = None, now.count()
    while n:
        kept = lambda df: stored(df, "star-lowest") if 2 * n > HOT_ROWS else df  # noqa: B023, E731
        both = now.unionByName(now.select(right.alias("u"), left.alias("v")))
        lowest = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = joined_to_groups(both, lowest, ["u"], "n", 2 * n).where(right > left).select(right.alias("u"), F.col("m").alias("v")).where(left != right).distinct()
        large = stored(large, "large-star")
        lowest = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small_star = joined_to_groups(large, lowest, ["u"], "n", 2 * n).select(F.when(right != F.col("m"), right).otherwise(left).alias("u"), F.col("m").alias("v"))
        now = stored(small_star.distinct(), "small-star")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if seen == before:
            break
        before, n = seen, seen[0]
    return now.select(left.alias("node"), right.alias("root")).unionByName(now.select(right.alias("node"), right.alias("root")).distinct())


def portions(batches: Iterator[pd.DataFrame], chars: int = PORTION) -> Iterator[pd.DataFrame]:
    """Parts of batches whose texts have about ``chars`` characters together (one text at least)."""
    for batch in batches:
        part = batch["text"].str.len().cumsum() // chars
        for _, rows in batch.groupby(part.to_numpy(), sort=False):
            yield rows.reset_index(drop=True)
