"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length within each source. A source whose
target asks for k whole copies takes each of its documents k times; the rest of
the target is a budget to be met by a subset. Each length gives its
proportional share of documents, rounded down; a bounded-knapsack dynamic
program then exchanges documents, putting some in and taking others out, until
no subset of the source comes nearer to the budget. Its window of sums grows
as far as that takes, so it holds for any lengths.
Which documents of a length are taken is a matter of a seeded hash: those below
a threshold that is found exactly, by the square root of their number of hash
ranges.

Space: the histogram of a source has as many rows as different lengths occur,
at most the square root of twice its words; no other table is brought into one
task, and documents meet the plan through a checked broadcast or a shuffle.

Edge cases: a null text has no words; the null source is a source of its own
and comes last; documents without words are never needed and count as taken 0;
rows that repeat in id, source and text are told apart by their number only; a
very long document is a length like others; an empty table gives an empty
result; the mix keeps columns of whatever name.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import small, stored, whole_row, word_count
from cohortlens.llm.sharding import row_numbered

WEIGHTS = (3.0, 1.0, 2.0)
MOST = 2.0


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target.

    All targets together are ``share`` of all sizes; one that exceeds ``most``
    times its source's size stops there and the others share the excess by
    weight, again and again until none does. Every step is an aggregate over
    the table of sources.
    """
    ordered = sizes.withColumn("_last", F.col("source").isNull())
    numbered, _ = row_numbered(ordered, ["_last", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("row_number", F.lit(len(weights))) + 1).cast("int"))
    table = stored(numbered.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(most)).alias("_cap")), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        stop = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, capped, open_weight = table.agg(F.count_if(stop), F.sum(F.when(stop, F.col("_cap"))), F.sum(F.when(~stop, F.col("_w")))).first()
        if n == before or not open_weight:
            break
        before, level = n, max(level, (share * total - (capped or 0.0)) / open_weight)
    return table.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def _nearest(bits: int, at: int, upper: bool = False) -> int:
    """The set bit nearest to ``at``, the lower (or upper) of two."""
    below, above = (bits & (1 << at + 1) - 1).bit_length() - 1, bits >> at
    up = at + (above & -above).bit_length() - 1 if above else None
    return up if below < 0 or up is not None and up - at < at - below + upper else below


def _least_error(lengths: np.ndarray, add: np.ndarray, drop: np.ndarray, gap: int) -> int:
    """A bound below on how near ``gap`` any exchange can come, from remainders.

    The commonest lengths are taken without limit, so only the remainder by
    their common divisor counts; the others give what remainders they can.
    """
    order = np.argsort(-(add + drop), kind="stable")
    divisors = np.gcd.accumulate(lengths[order]).tolist()
    least = 0
    for j, m in enumerate(divisors):
        if j + 1 < len(divisors) and divisors[j + 1] == m:
            continue  # a longer list has the same divisor
        reach, full = 1, (1 << m) - 1
        for i in order[j + 1 :]:
            for n, sign in ((int(add[i]), 1), (int(drop[i]), -1)):
                n, part = min(n, m), 1
                while n > 0 and reach != full:
                    k = min(part, n)
                    turn = sign * k * int(lengths[i]) % m
                    reach |= (reach << turn | reach >> m - turn) & full
                    n, part = n - k, part * 2
        at = gap % m
        least = max(least, abs(_nearest(reach | reach << m | reach << 2 * m, m + at) - m - at))
    return least


def _exchange(lengths: np.ndarray, add: np.ndarray, drop: np.ndarray, gap: int, upper: bool) -> np.ndarray:
    """Documents of each length to add (below 0: to leave out) so that their words come as near ``gap`` as any choice can.

    Bounded knapsack over a window of sums around ``gap``: bit s of ``reach``
    is set when s words can be made up, counts are split into powers of two.
    The window grows until the fit is as good as remainders allow, or holds
    all sums there are, so the result is the best there is.
    """
    change = np.zeros(len(lengths), np.int64)
    least = _least_error(lengths, add, drop, gap)
    up, down = int((lengths * add).sum()), int((lengths * drop).sum())
    most = max(up - gap, down + gap, 0)
    width = min(most, max(64, 2 * gap))
    while True:
        reach, mask, steps = 1 << width - gap, (1 << 2 * width + 1) - 1, []
        for i in np.argsort(lengths, kind="stable"):
            size = int(lengths[i])
            if size > 2 * width or reach >> width & 1:
                break
            for n, sign in ((int(add[i]), 1), (int(drop[i]), -1)):
                n, part = min(n, 2 * width // size), 1
                while n > 0 and not reach >> width & 1:
                    k = min(part, n)
                    grown = reach | (reach << k * size & mask if sign > 0 else reach >> k * size)
                    if grown != reach:
                        steps.append((i, sign * k, reach))
                    reach, n, part = grown, n - k, part * 2
        at = _nearest(reach, width, upper)
        if abs(at - width) <= least or width >= most:
            break
        width = min(most, 4 * width)
    for i, k, earlier in reversed(steps):
        if not earlier >> at & 1:
            change[i] += k
            at -= k * int(lengths[i])
    return change


def fitted(lengths: np.ndarray, counts: np.ndarray, target: float) -> np.ndarray:
    """How many documents of each length (all over 0) to take so that their words come as near ``target``, rounded, as any subset's."""
    budget = round(target)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        n = max(0, min(int(counts[i] - taken[i]), rest // int(lengths[i])))
        taken[i] += n
        rest -= n * int(lengths[i])
    return taken + _exchange(lengths, counts - taken, taken, rest, target > budget)


def _plan(source: pd.DataFrame) -> pd.DataFrame:
    rows = source[source["size"] > 0].sort_values("size")
    target, whole = float(source["target"].iloc[0]), int(source["source_size"].iloc[0])
    copies = int(target // whole) if whole else 0
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    more = fitted(lengths, counts, target - copies * whole) if len(rows) else counts
    return rows.assign(copies=copies, more=more)[["source", "size", "n", "source_size", "target", "copies", "more"]]


_HALF = 1 << 62
KEYS = ["_source", "_size", "_hash"]


def _keys(seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """_source, _size and _hash (in [0, 2**62)) of a document."""
    own = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(_HALF).cast("long"))
    return [F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), own.alias("_hash")]


def plan(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The narrow rows (_id, _source, _size, _hash) and the plan.

    The plan has a row for each source and length: _source, _size, source_size,
    target, copies, threshold, at and alike; a document is taken ``copies``
    times, and once more if its hash is at most the threshold. Of the ``alike``
    rows at the threshold (rows that repeat), only ``at`` are, if that isn't null.
    """
    rows = stored(documents.select(F.col(id_col).alias("_id"), *_keys(seed, id_col, text_col, source_col)), "mix-rows")
    hist = stored(rows.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.count("*").alias("n")), "mix-lengths")
    goals = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, share)
    goals = stored(goals, "mix-targets")
    joined = hist.join(small(goals, 100), hist["source"].eqNullSafe(goals["source"])).select(hist["source"], "size", "n", "source_size", "target")
    kind = documents.schema[source_col].dataType.simpleString()
    schema = f"source {kind}, size long, n long, source_size long, target double, copies int, more long"
    budget = stored(joined.groupBy("source").applyInPandas(_plan, schema), "mix-budget")

    # hash ranges, as many as a range has documents; then the hashes of the range that the cut falls into
    part = budget.where("more > 0 and more < n").select("source", "size", "more", F.ceil(F.sqrt("n")).alias("_ranges"))
    some = small(part, 64)
    on = rows["_source"].eqNullSafe(some["source"]) & (rows["_size"] == some["size"])
    width = F.floor(F.lit(_HALF).cast("long") / F.col("_ranges")).cast("long") + 1
    ranged = rows.join(some, on).select("source", "size", "more", "_hash", F.call_function("div", F.col("_hash"), width).alias("_range"))
    per_range = ranged.groupBy("source", "size", "more", "_range").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source", "size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = per_range.withColumn("_before", F.coalesce(F.sum("n").over(along), F.lit(0))).where("_before < more and _before + n >= more")
    cut = stored(cut.select("source", "size", "_range", (F.col("more") - F.col("_before")).alias("_need")), "mix-cut")
    edge = small(cut, 64)
    same = ranged["source"].eqNullSafe(edge["source"]) & (ranged["size"] == edge["size"]) & (ranged["_range"] == edge["_range"])
    near = ranged.join(edge, same).select(ranged["source"].alias("_s"), ranged["size"].alias("_z"), "_hash", "_need").groupBy("_s", "_z", "_need", "_hash").agg(F.count("*").alias("alike"))
    within = Window.partitionBy("_s", "_z").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_need") - F.coalesce(F.sum("alike").over(within), F.lit(0))
    thresholds = near.withColumn("at", at).where("at > 0 and at <= alike").select("_s", "_z", F.col("_hash").alias("_threshold"), F.when(F.col("at") < F.col("alike"), F.col("at")).alias("at"), "alike")
    match = budget["source"].eqNullSafe(thresholds["_s"]) & (budget["size"] == thresholds["_z"])
    threshold = F.when(F.col("more") == 0, F.lit(-1)).when(F.col("more") >= F.col("n"), F.lit(_HALF)).otherwise(F.col("_threshold")).cast("long")
    whole = budget.join(thresholds, match, "left").select(F.col("source").alias("_source"), F.col("size").alias("_size"), "copies", threshold.alias("threshold"), "at", "alike")
    none = F.lit(None).cast("long")
    nothing = hist.where("size = 0").select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.lit(0).alias("copies"), F.lit(-1).cast("long").alias("threshold"), none.alias("at"), none.alias("alike"))
    decided = whole.unionByName(nothing)
    out = decided.join(small(goals, 100), decided["_source"].eqNullSafe(goals["source"])).select("_source", "_size", "source_size", "target", "copies", "threshold", "at", "alike")
    return rows, stored(out, "mix-plan")


def _decided(rows: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with _source_size, _target and _times; and apart, if there are any, rows alike of which only some are taken once more (with _copies, _wanted, _alike)."""
    names = {"source_size": "_source_size", "target": "_target", "copies": "_copies", "threshold": "_threshold", "at": "_wanted", "alike": "_alike"}
    p = small(decided.withColumnsRenamed(names), 100)
    on = rows["_source"].eqNullSafe(p["_source"]) & (rows["_size"] == p["_size"])
    joined = rows.join(p, on).select(*[rows[c] for c in rows.columns], *names.values())
    some = F.col("_wanted").isNotNull() & (F.col("_hash") == F.col("_threshold"))
    sure = joined.where(~some).withColumn("_times", F.col("_copies") + (F.col("_hash") <= F.col("_threshold")).cast("int"))
    return sure, joined.where(some) if decided.where("at is not null").limit(1).count() else None


def mix_report(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    rows, decided = plan(documents, weights, share, seed, id_col, text_col, source_col)
    found, alike = _decided(rows, decided)
    if alike is not None:  # equal rows are numbered over several tasks
        numbered = stored(row_numbered(stored(alike, "mix-equal"), KEYS)[0], "mix-alike")
        first = numbered.groupBy(*KEYS).agg(F.min("row_number").alias("_first")).withColumnsRenamed({k: f"{k}_" for k in KEYS})
        same = F.col("_source").eqNullSafe(F.col("_source_")) & (F.col("_size") == F.col("_size_")) & (F.col("_hash") == F.col("_hash_"))
        ranked = numbered.join(small(stored(first, "mix-first"), 60), same)
        times = F.col("_copies") + (F.col("row_number") - F.col("_first") < F.col("_wanted")).cast("int")
        found = found.unionByName(ranked.withColumn("_times", times).select(*found.columns))
    return found.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_times").alias("copies"), (F.col("_size") * F.col("_times")).alias("taken"))


def mixed(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``documents``, each row as often as it is taken.

    Of rows that repeat in id, source and text, and that are taken unequally
    often, one stands for all, as often as they are taken together.
    """
    _, decided = plan(documents, weights, share, seed, id_col, text_col, source_col)
    found, alike = _decided(documents.select(whole_row(documents), *_keys(seed, id_col, text_col, source_col)), decided)
    found = found.where("_times > 0").select("_row", "_times")
    if alike is not None:
        together = (F.col("_copies") * F.col("_alike") + F.col("_wanted")).cast("int")
        found = found.unionByName(alike.dropDuplicates(KEYS).select("_row", together.alias("_times")))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
