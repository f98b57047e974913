"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups.

Rows are keyed by the MD5 of the normalised text. A narrow table of ids and
hashes decides who stays; the texts of groups with more than one row are
compared through ``min`` and ``max`` per group, which both agree only when all
bytes do. Those aggregates combine on the map side, so a group with a third of
all rows sends one pair of texts per task. A hash met by different texts is
split by their SHA-256 and compared again.

Edge cases: null text counts as empty; texts of white space only become one
space; a null id is no id: among equal texts the smallest non-null id stays,
and if none has an id, one of them; of entirely equal rows one is kept; a very
long text is compared whole; an empty table gives an empty result; columns of
whatever name are returned as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE, joined_to_groups, small, stored, whole_row


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(text: Column) -> Column:
    """128-bit hash of a normalised text, as bytes."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _differing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose texts (``_norm``) aren't all the same bytes."""
    found = rows.groupBy(*keys).agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi"))
    return found.where(F.col("lo") != F.col("hi")).select(*keys)


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``hash_of`` maps the normalised text column to the group hash; tests pass
    a weak one to force collisions.
    """
    norm = normalised(F.col(text_col))
    texts = documents.select(norm.alias("_norm")).withColumns({"_h": hash_of(F.col("_norm")), "_sha": F.sha2(F.encode("_norm", "UTF-8"), 256)})
    rows = stored(
        documents.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"))
        .select("doc_id", hash_of(F.col("_norm")).alias("_h"), F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_rid")),
        "dedup-rows",
    )
    repeated = stored(rows.groupBy("_h").count().where("count > 1").select("_h"), "dedup-repeated")
    suspects = texts.join(small(repeated, 32), "_h", "left_semi")
    clashing = stored(_differing(suspects, ["_h"]), "dedup-clashing")
    split = F.lit(False)
    if clashing.limit(1).count():
        again = suspects.join(clashing, "_h", "left_semi")
        if _differing(again, ["_h", "_sha"]).limit(1).count():
            raise RuntimeError("different texts share a 128-bit hash and a SHA-256; refusing to merge them")
        rows = rows.join(clashing.withColumn("_split", F.lit(True)), "_h", "left")
        split = F.coalesce(F.col("_split"), F.lit(False))
    rows = rows.withColumn("_sub", F.when(split, F.col("text_sha256")).otherwise(F.lit("")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid"))
    groups = stored(rows.groupBy("_h", "_sub").agg(first.alias("_first"), F.count("*").alias("group_size")), "dedup-groups")
    joined = joined_to_groups(rows, groups, ["_h", "_sub"], "group_size", rows.count())
    return joined.select("doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("_first._rid")).alias("kept"), "text_sha256")


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns.

    Rows are matched by id and SHA-256 of the normalised text; rows equal in
    both are the same document, of which one stays.
    """
    groups = exact_groups(documents, id_col, text_col)
    dropped = stored(groups.where("not kept").select("doc_id", "text_sha256", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("_twin")).distinct(), "dedup-dropped")
    keyed = documents.select(whole_row(documents), F.col(id_col).alias("_id"), F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256).alias("_sha"))
    gone = small(dropped.where("not _twin").select(F.col("doc_id").alias("_did"), F.col("text_sha256").alias("_dsha")), 100)
    match = F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_sha") == F.col("_dsha"))
    kept = keyed.join(gone, match, "left_anti")
    twins = dropped.where("_twin").select(F.col("doc_id").alias("_did"), F.col("text_sha256").alias("_dsha"))
    if twins.limit(1).count():  # the same document delivered more than once
        once = kept.join(small(twins, 100), match, "left_semi").dropDuplicates(["_id", "_sha"])
        kept = kept.join(small(twins, 100), match, "left_anti").unionByName(once)
    return kept.select("_row.*")
