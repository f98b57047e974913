"""Tables written to the shared folder: a plan that would be run again is run once and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on a single machine, where that is unset, a temporary folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table below the shared folder, in folders of the last columns ``by``, if any.

    The optimiser knows the size of such a table, so it broadcasts it in a join
    only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(of: Callable, items: Iterable, most: int = 8) -> list:
    """``of`` each item, in order, whose Spark jobs may run side by side: short ones fill the cores that others leave idle."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(inheritable_thread_target(of), items))


def clear(spark: SparkSession) -> int:
    """Delete the tables stored so far by this driver; what was read from them must have been written elsewhere. Returns their number."""
    n = len(_written)
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks can open it themselves; nothing if it isn't in a file system of the machines."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class Bucketed:
    """A table on the shared folder whose rows lie in ``n`` buckets by a key: two such tables join on it without a shuffle."""

    table: DataFrame
    n: int
    name: str = ""
    path: str = ""

    @staticmethod
    def write(df: DataFrame, n: int, key: str, dealt: bool = False) -> Bucketed:
        """Rows are dealt out by the key once, unless (``dealt``) they come from buckets of such a table."""
        spark = df.sparkSession
        name = f"cohortlens_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{name}"
        (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
        _written.append(path)
        return Bucketed(spark.table(name), n, name, path)

    def read(self) -> DataFrame:
        return self.table

    def drop(self) -> None:
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        deleted(spark, self.path)
        if self.path in _written:
            _written.remove(self.path)
