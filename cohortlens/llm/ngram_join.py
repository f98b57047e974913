"""N-gram Jaccard self-join by vertical partitioning, as classes of linked documents.

A document is the set of its word n-grams, each a 64-bit hash; the order of the
hashes is the global n-gram order. Pairs are found and counted in fragments of
that order:

1. Documents with equal sets form one node; a node is known by a 128-bit hash of its set.
2. Two sets that link differ in at most ``min/ratio`` n-grams, so of a set's
   non-empty fragments all but as many hold the same n-grams in both. Each node
   hands in the segments of all its non-empty fragments, for each band of sizes
   that a partner may have. Where these aren't more than may differ (short
   sets), it also hands in its first n-grams, one more than may differ: two such
   sets share the smallest of their common n-grams there. A node that shares
   fewer segments of a band with others than any partner would leave equal is
   out of that band; this is asked twice, as those that leave take segments with
   them. Nodes of equal segments are then tied to the smallest of them; connected
   ties within a band are candidate groups. No pairs are made: a segment that n
   nodes share gives n - 1 ties.
3. Each candidate group is cut into blocks of bounded size. For each two blocks
   the order is again cut into fragments, the overlaps of all their pairs are
   counted fragment by fragment as matrix products and summed per pair. A link
   counts in the band of its smaller set only. A spanning forest of the links
   leaves the task, with each node's number of links.
4. Connected components of the forests are the classes.

Edge cases: null and empty texts have no n-grams, link with nothing and form
their own class; a text of fewer words than n is one n-gram; a null id never
names a class unless all its members lack one; repeated rows are copies; a very
long text is one row of n-grams, hashed in portions; an empty table gives an
empty result; other columns, of whatever name, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import HOT_ROWS, components, joined_to_groups, portions, small, stored, whole_row

#: Nodes and n-grams that a block of a candidate group holds at most, about.
BLOCK_NODES = 1024
BLOCK_GRAMS = 1_000_000
#: n-grams of the global order that a fragment of the counting step holds.
COUNTED = 4096
#: Ratio of neighbouring size bands in the candidate step.
BAND = 1.25
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; words are lower-cased in A-Z and cut at ASCII white space."""
    words = [t.encode().lower().split() for t in texts]
    flat = np.empty(sum(map(len, words)), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(flat, categorize=False).astype(np.uint64) if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in words:
        h = hashes[at : at + len(ws)]
        at += len(ws)
        k = min(n, len(h))
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        grams = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            grams = mixed64(grams * _GOLD + h[j : len(h) - k + 1 + j])
        out.append(np.unique(grams))
    return out


def set_key(grams: np.ndarray) -> bytes:
    """128-bit name of a set, from two sums over its members."""
    with np.errstate(over="ignore"):
        a = mixed64(grams + _GOLD).sum(dtype=np.uint64)
        b = mixed64(grams ^ _MIX1).sum(dtype=np.uint64) + np.uint64(len(grams))
    return mixed64(np.array([a, b])).tobytes()


def most_different(size: int, percent: int) -> int:
    """Most n-grams by which two linked sets differ (in either), the smaller having ``size``."""
    return (100 - percent) * size // percent


def band_end(low: int) -> int:
    """The lower end of the next size band."""
    return max(low + 1, int(low * BAND))


def bands(percent: int, largest: int) -> list[int]:
    """Lower ends of the size bands; the first is the least size at which sets can link and differ."""
    low = -(-percent // (100 - percent))
    out = [low]
    while out[-1] <= largest:
        out.append(band_end(out[-1]))
    return out


def segments(grams: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, need, segments): the segments that a set hands in for a band, and how many of them a partner has, too."""
    n = len(grams)
    least = -(-percent * n // 100)
    lows = bands(percent, n)
    found = []
    for low, end in zip(lows, lows[1:]):
        if end <= least or low > n:
            continue  # no partner's or own size, as the smaller of the two, lies in this band
        allowed = most_different(end - 1, percent)
        pieces = np.uint64(allowed + allowed // 4 + 2)
        fragment = ((grams >> np.uint64(32)) * pieces) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mixed64(grams + _MIX2), starts)
            seg = mixed64(sums * _GOLD + fragment[starts] + np.uint64(low) * _MIX1)
        seg = np.unique(seg >> np.uint64(16))  # 48 bits travel; equal numbers of unequal segments only add candidates
        need = len(seg) - allowed
        if need < 1:  # a partner may touch all these fragments; of two such sets the smallest common n-gram is in both prefixes
            with np.errstate(over="ignore"):
                prefix = mixed64(grams[: allowed + 1] * _GOLD + np.uint64(low) * _MIX2)
            seg = np.unique(np.r_[seg, prefix >> np.uint64(16)])
        found.append((low, max(1, need), seg.view(np.int64)))
    return found


def forest(sets: list[np.ndarray], other: list[np.ndarray] | None, percent: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of band ``low`` among ``sets`` (or between them and ``other``) by fragment-wise overlap counts: labels of a spanning forest, and the link matrix."""
    every = sets + (other or [])
    sizes = np.array([len(s) for s in every])
    flat = np.concatenate(every)
    owner = np.repeat(np.arange(len(every), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    gram = np.cumsum(np.r_[True, flat[1:] != flat[:-1]], dtype=np.int32) - 1
    shared = np.bincount(gram)[gram] > 1
    gram, owner = gram[shared], owner[shared]
    if len(gram):
        gram = np.cumsum(np.r_[True, gram[1:] != gram[:-1]], dtype=np.int32) - 1
    a, b = len(sets), len(every)
    overlap = np.zeros((a, b), np.float32 if max(sizes.max(), 1) < 1 << 24 else np.float64)
    cuts = np.searchsorted(gram, np.arange(0, (int(gram[-1]) if len(gram) else -1) + 1, COUNTED)).tolist() + [len(gram)]
    for lo, hi in zip(cuts, cuts[1:]):
        part = np.zeros((b, int(gram[hi - 1] - gram[lo]) + 1), np.float32)
        part[owner[lo:hi], gram[lo:hi] - gram[lo]] = 1
        overlap += part[:a] @ part.T
    links = 100 * overlap >= percent * (sizes[:a, None] + sizes[None, :] - overlap)
    smaller = np.minimum(sizes[:a, None], sizes[None, :])
    links &= (smaller >= low) & (smaller < band_end(low))
    links[np.arange(a), np.arange(a)] = False
    if other is not None:
        links[:, :a] = False
    label = np.arange(b)
    rows, cols = np.nonzero(links)
    while len(rows):  # hook both ends to the smaller label, then shorten
        low = np.minimum(label[rows], label[cols])
        np.minimum.at(label, label[rows], low)
        np.minimum.at(label, label[cols], low)
        while (label != label[label]).any():
            label = label[label]
        if (label[rows] == label[cols]).all():
            break
    return label, links


def _fingerprints(n: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in portions(batches):
            sets = gram_sets(batch["text"].tolist(), n)
            nodes = [set_key(s) if len(s) else None for s in sets]
            handed = []
            for s, node in zip(sets, nodes):
                fresh = node is not None and node not in seen
                handed.append([{"band": b, "need": k, "hashes": h} for b, k, h in segments(s, percent)] if fresh else None)
                if fresh:
                    seen.add(node)
            if len(seen) > 200_000:
                seen.clear()
            yield batch[["doc_id", "said"]].assign(n_shingles=[len(s) for s in sets], node=nodes, segments=handed)

    return run


def _grams(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches):
            sets = gram_sets(batch["text"].tolist(), n)
            yield pd.DataFrame({"node": [set_key(s) if len(s) else None for s in sets], "grams": [s.view(np.int64) for s in sets]})

    return run


def _counted(percent: int):
    """Over rows sorted by (root, band, i, j): links of each block pair, as soon as it is complete."""

    def links_of(key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        _, band, i, j = key
        once = {node: (block, copies, grams) for node, block, copies, grams in rows}
        own = sorted(node for node, x in once.items() if x[0] == i)
        others = sorted(node for node, x in once.items() if x[0] == j) if i != j else []
        if not own or i != j and not others:
            return
        label, links = forest([once[x][2] for x in own], [once[x][2] for x in others] if i != j else None, percent, band)
        names, copies = np.array(own + others, dtype=object), np.array([once[x][1] for x in own + others], np.int64)
        count = links @ copies
        if i != j:
            count = np.r_[count, links[:, len(own) :].T @ copies[: len(own)]]
        out = pd.DataFrame({"node": names, "tied": names[label], "links": count})
        if (out["links"] > 0).any():
            yield out[out["links"] > 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for batch in batches:
            for root, band, i, j, node, block, copies, grams in batch.itertuples(index=False, name=None):
                if (root, band, i, j) != key:
                    if rows:
                        yield from links_of(key, rows)
                    key, rows = (root, band, i, j), []
                rows.append((node, block, copies, np.asarray(grams, np.int64).view(np.uint64)))
        if rows:
            yield from links_of(key, rows)

    return run


SEGMENTS = "array<struct<band:int,need:int,hashes:array<long>>>"


#: Buckets in which segments are counted to find the hot ones, and the share of all rows from which a bucket is hot.
BUCKETS, HOT_BUCKETS = 1 << 16, 1 << 13


def _shared(handed: DataFrame) -> DataFrame:
    """Of rows (at, segment) those whose segment comes from several places, with the smallest such place (``tied``).

    One shuffle by segment. Segments in buckets with a large share of all rows
    are aggregated first, with map-side combining, and joined back, so no hot
    segment comes together in one task.
    """
    bucket = F.pmod("segment", F.lit(BUCKETS)).cast("int")
    counted = handed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).toPandas()  # at most BUCKETS rows
    total = int(counted["n"].sum())
    found = counted["bucket"][counted["n"] > max(HOT_ROWS, total // HOT_BUCKETS)].tolist()  # fewer than HOT_BUCKETS
    hot = handed.sparkSession.createDataFrame([(b,) for b in found], "bucket int")
    same = Window.partitionBy("segment")
    ends = [F.min("at").over(same).alias("tied"), F.max("at").over(same).alias("_hi")]
    rest = handed.select("at", "segment", bucket.alias("bucket"))
    if not found:
        return rest.select("at", "segment", *ends).where("tied <> _hi").drop("_hi")
    cold = rest.join(F.broadcast(hot), "bucket", "left_anti").select("at", "segment", *ends).where("tied <> _hi").drop("_hi")
    warm = rest.join(F.broadcast(hot), "bucket", "left_semi")
    several = warm.groupBy("segment").agg(F.min("at").alias("tied"), F.max("at").alias("_hi"), F.count("*").alias("n")).where("tied <> _hi")
    several = stored(several.select("segment", "tied", "n"), "jaccard-hot")
    return cold.unionByName(joined_to_groups(warm, several, ["segment"], "n", total).select("at", "segment", "tied"))


def _alive(handed: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """The shared segments of places that share as many as any partner would."""
    found = stored(_shared(handed).select("at", "segment"), f"{name}-found")
    count = found.groupBy("at").agg(F.countDistinct("segment").alias("n"))
    enough = stored(count.join(small(places.select("at", "need"), 16), "at").where("n >= need").select("at").distinct(), f"{name}-enough")
    return found.join(small(enough, 12), "at", "left_semi")


def _classes(documents: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, said (a hash of its text), n_shingles, n_links and first.

    ``first`` (no_id, id, said) stands for the class: its smallest id, and of
    texts with that id the one of smallest hash; it is null for a document
    without n-grams.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("said"), text.alias("text"))
    marks = stored(plain.mapInPandas(_fingerprints(n, percent), f"doc_id {kind}, said long, n_shingles long, node binary, segments {SEGMENTS}"), "jaccard-marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "said")).alias("first")
    nodes = marks.where("node is not null").groupBy("node").agg(first, F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    nodes = stored(nodes, "jaccard-nodes")

    # a node has a place in each of its bands
    handed = marks.where("segments is not null").select("node", F.explode("segments").alias("s")).withColumn("at", F.xxhash64("node", "s.band"))
    places = stored(handed.select("at", "node", "s.band", "s.need").distinct(), "jaccard-places")
    alive = _alive(handed.select("at", F.explode("s.hashes").alias("segment")), places, "jaccard-once")
    alive = _alive(alive, places, "jaccard-twice")
    ties = _shared(alive).where("at <> tied").select("at", "tied")
    groups = components(ties, "at", "tied").withColumnRenamed("node", "at")

    members = stored(groups.join(places, "at").join(nodes, "node"), "jaccard-members")
    sizes = members.groupBy("root").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("g"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_NODES), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    placed = joined_to_groups(members, stored(sizes.select("root", "k", blocks.alias("blocks")), "jaccard-blocks"), ["root"], "k", members.count())
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = stored(placed.select("root", "band", "node", "first", "copies", "blocks", "block"), "jaccard-placed")

    wanted = small(placed.select("first.id", F.col("first.said").alias("_said")).distinct(), 32)
    texts = plain.join(wanted, plain["doc_id"].eqNullSafe(wanted["id"]) & (plain["said"] == wanted["_said"]), "left_semi")
    grams = texts.mapInPandas(_grams(n), "node binary, grams array<long>")
    with_grams = grams.join(small(placed, 100), "node")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"))))
    spread = with_grams.select("root", "band", pair.alias("p"), "node", "block", "copies", "grams").select("root", "band", "p.i", "p.j", "node", "block", "copies", "grams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = spread.repartition(parts, "root", "band", "i", "j").sortWithinPartitions("root", "band", "i", "j")
    found = stored(sorted_rows.mapInPandas(_counted(percent), "node binary, tied binary, links long"), "jaccard-links")

    linked = components(found, "node", "tied").withColumnRenamed("root", "class")
    classes = linked.join(nodes.select("node", "first"), "node")
    named = stored(classes.groupBy("class").agg(F.min("first").alias("named"), F.count("*").alias("k")), "jaccard-classes")
    classes = joined_to_groups(linked, named, ["class"], "k", named.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]).select("node", "named")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.join(classes, "node", "left").join(counts, "node", "left")
    of_node = of_node.select("node", F.coalesce("named", "first").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    of_node = stored(of_node, "jaccard-result")
    named_rows = marks.where("node is not null").select("doc_id", "said", "n_shingles", "node")
    out = joined_to_groups(named_rows, of_node, ["node"], "copies", named_rows.count()).select("doc_id", "said", "n_shingles", "n_links", "first")
    alone = marks.where("node is null").select("doc_id", "said", "n_shingles", F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone, allowMissingColumns=True)


def jaccard_classes(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and n_links (documents that it links with).

    Documents link when 100 * intersection >= percent * union of their sets of
    word n-grams; ``component_id`` is the smallest id of a class.
    """
    named = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id"))
    return _classes(documents, n, percent, id_col, text_col).select("doc_id", "n_shingles", named.alias("component_id"), "n_links")


def representatives(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay: of each class the one with the smallest id.

    Rows are known by id and text; of rows equal in both, one of those that
    stand for a class stays. Documents without words all stay.
    """
    classes = _classes(documents, n, percent, id_col, text_col).where("first is not null")
    stands = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("said") == F.col("first.said"))
    known = classes.groupBy(F.col("doc_id").alias("_did"), F.col("said").alias("_dsaid")).agg(F.max(stands).alias("_stands"), F.count("*").alias("_n"))
    known = stored(known.where("not _stands or _n > 1"), "jaccard-known")
    keyed = documents.select(whole_row(documents), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_said"))
    same = F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_said") == F.col("_dsaid"))
    left = keyed.join(small(known.select("_did", "_dsaid"), 24), same, "left_anti").select("_row")
    again = known.where("_stands")
    if again.limit(1).count():  # rows delivered more than once
        once = keyed.join(small(again, 24), same, "left_semi").dropDuplicates(["_id", "_said"])
        left = left.unionByName(once.select("_row"))
    return left.select("_row.*")
