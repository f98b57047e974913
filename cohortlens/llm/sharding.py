"""Sharding: a Feistel permutation of global row numbers gives every row a shard and a slot.

Rows are numbered in a total order of their content, the number is permuted by
a keyed Feistel network over ``a * b >= N`` cells, and numbers that leave
``[0, N)`` walk the cycle until they return. Shard and slot are the remainder
and the quotient of the permuted number, so shard sizes differ by one row at
most, slots have no gaps, and :func:`address` finds a row's place (and
:func:`row_at` the row of a place) without reading any table.

Everything is a column expression; no Python runs on the executors.

Edge cases: a null text has no bytes, so size 8 and the CRC of an empty
string; a null id sorts first; rows that repeat entirely are interchangeable
and take consecutive row numbers; a very long text is a row like others; an
empty table gives an empty result; other columns, of whatever name, aren't
returned.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

ROUNDS = 6
ROW_OVERHEAD = 8


def _grid(n_rows: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds n_rows cells."""
    a = isqrt(max(n_rows - 1, 0)) + 1
    return a, -(-max(n_rows, 1) // a)


def _mixed(x: Column, seed: int, k: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(seed).cast("long"), F.lit(k)), F.lit(modulus).cast("long"))


def _forward(p: Column, n_rows: int, seed: int) -> Column:
    a, b = _grid(n_rows)
    right = F.pmod(p, F.lit(b).cast("long"))
    left = F.call_function("div", p, F.lit(b).cast("long"))
    for k in range(0, ROUNDS, 2):
        left = F.pmod(left + _mixed(right, seed, k, a), F.lit(a).cast("long"))
        right = F.pmod(right + _mixed(left, seed, k + 1, b), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def _backward(p: Column, n_rows: int, seed: int) -> Column:
    a, b = _grid(n_rows)
    right = F.pmod(p, F.lit(b).cast("long"))
    left = F.call_function("div", p, F.lit(b).cast("long"))
    for k in reversed(range(0, ROUNDS, 2)):
        right = F.pmod(right - _mixed(left, seed, k + 1, b), F.lit(b).cast("long"))
        left = F.pmod(left - _mixed(right, seed, k, a), F.lit(a).cast("long"))
    return left * F.lit(b).cast("long") + right


def _walked(step, p: Column, n_rows: int, seed: int) -> Column:
    """One step, then more until the number is below n_rows again.

    The grid has fewer than ``a`` cells beyond n_rows, and a cycle can't meet
    one of them twice before it returns, so as many further steps suffice.
    Few rows need any; the rest never evaluate that branch.
    """
    a, b = _grid(n_rows)
    inside = F.lit(n_rows).cast("long")
    first = step(p, n_rows, seed)
    extra = a * b - n_rows
    if extra <= 0:
        return first
    more = F.aggregate(F.sequence(F.lit(1), F.lit(extra)), first, lambda acc, _: F.when(acc < inside, acc).otherwise(step(acc, n_rows, seed)))
    return F.when(first < inside, first).otherwise(more)


def permuted(row_number: Column, n_rows: int, seed: int = 0) -> Column:
    """Place in [0, n_rows) of a row number in [0, n_rows); a bijection."""
    return _walked(_forward, row_number.cast("long"), n_rows, seed)


def address(row_number: Column, n_rows: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """Shard and slot of a row number."""
    p = permuted(row_number, n_rows, seed)
    return F.pmod(p, F.lit(shards).cast("long")).cast("int"), F.call_function("div", p, F.lit(shards).cast("long"))


def row_at(shard: Column, slot: Column, n_rows: int, shards: int, seed: int = 0) -> Column:
    """Row number at a shard's slot: the inverse of :func:`address`."""
    return _walked(_backward, slot.cast("long") * F.lit(shards).cast("long") + shard.cast("long"), n_rows, seed)


def row_numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``row_number`` (from 0, in the order of the columns) and return the row count.

    Range partitions are sorted apart and shifted by the sizes of the earlier
    ones; only one count per partition is brought together. Rows that are
    equal in the columns follow their place in ``df``, a stored table, so
    that they, too, are dealt to several partitions.
    """
    keys = [*order, "_place"]
    spread = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place")
    local = stored(spread.withColumn("_at", F.monotonically_increasing_id()), "row-numbers")
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in local.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    spark = df.sparkSession
    starts_df = spark.createDataFrame(starts, "_part long, _start long")
    numbered = local.join(F.broadcast(starts_df), part == F.col("_part"))
    return numbered.withColumn("row_number", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start"), total


def feistel_shards(documents: DataFrame, shards: int = 24, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot for every row, with law ``rows``.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stored(
        documents.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_h"),
        ),
        "shard-rows",
    )
    numbered, n = row_numbered(narrow, ["doc_id", "_h", "text_crc32"])
    shard, slot = address(F.col("row_number"), n, shards, seed)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
