"""Substring dedup by difference-cover anchors: passages of ``window`` words or more stay where they come first.

A word is removed if it lies in a window of ``window`` words that also starts
earlier: in a document of smaller id, or before it in the same one.

1. Anchors. Of each document only the windows of ``window - v + 1`` words that
   start at cover positions modulo the period v are hashed. A difference cover
   holds two places at any distance modulo v, so two equal windows of ``window``
   words, wherever they lie, hold an equal pair of anchors at the same offset.
   A task sends the distinct hashes of a portion of text, packed by hash bucket
   and four bytes each; the bucket sends back a bit for each: met in another
   portion or not. About a third of all words is an anchor, so about 1.2 bytes a
   word are shuffled.
2. Extension. Every window of ``window`` words around a repeated anchor is a
   candidate. Its name of 96 bits and a bucket is sent like the anchors, and
   each bucket tells which of them is first in the order of ids. All other
   candidates are repeats; their words go.

No pairs are made: a passage of a third of all documents is one entry a portion
in one bucket, whose other entries are as many as in any bucket, and inside a
portion (``PORTION`` bytes of text) only its first place is sent. Portions are
rows of a table on the shared folder, so that a task that runs anew finds the
same ones; answers, some bits a word, are joined to them by broadcast only up to
a checked size.

Words of up to 16 bytes go into names by their bytes, longer ones by a digest of
128 bits; candidates of equal names count as equal texts.

Edge cases: null text has no words; texts with fewer words than a window lose
nothing; ids are whole numbers; null ids come after all others; rows of equal id
come in the order of a hash of their texts, of equal rows any one is first and
the others are repeats; a text of any length is one portion at least, of about
six times its size in a task's memory; an empty table gives an empty result;
other columns of the input, whatever their names, aren't returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import small, stored
from cohortlens.llm.ngram_join import mixed64

#: Period -> perfect difference cover: every distance modulo the period lies between two of its places.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bytes of text that are named at a time.
PORTION = 2 << 20
#: Words for each bucket of hashes.
BUCKET_WORDS = 1 << 20
NO_ID = (1 << 63) - 1
PORTIONS = "portion long, n_words long, ids array<long>, ties array<long>, texts array<string>"


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover: the largest period of at most two thirds of a window, so anchors have a third at least."""
    period = max(v for v in COVERS if v <= max(1, 2 * window // 3))
    return period, COVERS[period]


def _spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


class Words:
    """The words of some texts: places in their joined bytes, documents, names of two times 64 bits."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
        self.offsets, self.raw = offsets - offsets[0], raw
        inside = ~_spaces(raw)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]  # where a text begins a word does, too
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets[1:], self.starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.place = np.arange(len(self.starts)) - (np.cumsum(self.counts) - self.counts)[self.doc]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([self.raw, np.zeros(16, np.uint8)])
        lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        size = self.ends - self.starts
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        low, high = lanes[self.starts] & masks[np.minimum(size, 8)], lanes[self.starts + np.minimum(size, 8)] & masks[np.clip(size - 8, 0, 8)]
        held = self.raw.tobytes() if (size > 16).any() else b""
        for i in np.flatnonzero(size > 16):
            digest = hashlib.blake2b(held[self.starts[i] : self.ends[i]], digest_size=16).digest()
            low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
        size = mixed64(size.astype(np.uint64) + np.uint64(1))
        return mixed64(low + mixed64(high ^ size)), mixed64(high + mixed64(low + size))


def _factors(n: int, lane: int) -> np.ndarray:
    """Odd constants, one a place in a window."""
    return mixed64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(1000 * (lane + 1))) | np.uint64(1)


def hashed(names: np.ndarray, starts: np.ndarray, n: int, lane: int) -> np.ndarray:
    """Hashes of the ``n`` words from each of ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    for k, c in enumerate(_factors(n, lane)):
        out += names[starts + k] * c
    return mixed64(out)


def _fitting(words: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Those starts whose ``n`` words lie in one document."""
    return starts[words.place[starts] + n <= words.counts[words.doc[starts]]]


class Anchors:
    """The anchors of a portion; ``distinct`` are their hashes in bucket order, ``edges`` where each bucket begins."""

    def __init__(self, words: Words, names: np.ndarray, window: int, buckets: int):
        period, cover = cover_of(window)
        self.size = window - period + 1
        held = np.zeros(period, bool)
        held[list(cover)] = True
        self.starts = _fitting(words, np.flatnonzero(held[words.place % period]), self.size)
        self.hashes = hashed(names, self.starts, self.size, 0)
        found, counts = np.unique(self.hashes, return_counts=True)
        bucket = (found >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        self.distinct, self.again = found[order], counts[order] > 1
        self.edges = np.searchsorted(bucket[order], np.arange(buckets + 1))

    def packed(self, portion: int) -> pa.RecordBatch:
        """A row for each bucket: four bytes of each hash, the bucket holds more of it."""
        held = np.flatnonzero(np.diff(self.edges))
        marks = self.distinct.astype("<u4")
        rows = [marks[self.edges[b] : self.edges[b + 1]].tobytes() for b in held]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([portion] * len(held), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "portion", "marks"])

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """Starts of the anchors that are met again here or, by ``elsewhere`` (a flag for each of ``distinct``), in another portion."""
        sought = np.sort(self.distinct[self.again | elsewhere])
        at = np.minimum(np.searchsorted(sought, self.hashes), max(0, len(sought) - 1))
        return self.starts[sought[at] == self.hashes] if len(sought) else self.starts[:0]


class Candidates:
    """Windows around repeated anchors. ``starts`` are in the order of ids; ``first`` are the first ones of each name, in bucket order."""

    def __init__(self, words: Words, names: tuple[np.ndarray, np.ndarray], anchors: np.ndarray, anchor_size: int, window: int, buckets: int, rank: np.ndarray):
        near = np.zeros(len(words.starts) + 1, np.int32)
        back = np.minimum(words.place[anchors], window - anchor_size)
        np.add.at(near, anchors - back, 1)
        np.add.at(near, anchors + 1, -1)
        starts = _fitting(words, np.flatnonzero(np.cumsum(near[:-1])), window)
        self.starts = starts[np.argsort(rank[words.doc[starts]], kind="stable")]
        high, low = (hashed(names[i], self.starts, window, i + 1) for i in (0, 1))
        low &= np.uint64(0xFFFFFFFF)
        bucket = mixed64(high) % np.uint64(buckets)
        order = np.lexsort((low, high, bucket))  # stable: equal names stay in order
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.first = order[new]
        self.high, self.low = high[self.first], low[self.first].astype(np.uint32)
        self.edges = np.searchsorted(bucket[self.first], np.arange(buckets + 1))

    def repeats(self, known: np.ndarray) -> np.ndarray:
        """Starts of all but the first windows; ``known`` flags those of ``first`` that come earlier in another portion."""
        gone = np.ones(len(self.starts), bool)
        gone[self.first[~known]] = False
        return self.starts[gone]


def portioned(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``PORTIONS``: the texts of some documents, with ids, hashes of the texts to order equal ids, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, ties, texts = (batch.column(i) for i in range(3))
            sizes = np.array(pa.compute.binary_length(texts))
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff((ends - sizes) // PORTION)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a < b:
                    part = [x.slice(a, b - a) for x in (ids, ties, texts)]
                    n = int(Words(part[2]).counts.sum())
                    lists = [pa.array([x.to_pylist()], pa.list_(kind)) for x, kind in zip(part, (pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), *lists], names=["portion", "n_words", "ids", "ties", "texts"])
                    number += 1

    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, PORTIONS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Words, np.ndarray]]:
    """Each portion as a dictionary, its words, and the rank of its documents in the order of ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            words = Words(row["texts"].values)
            ids, ties = row["ids"].values.fill_null(NO_ID).to_numpy(), row["ties"].values.to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((ties, ids))] = np.arange(len(ids))
            yield row | {"ids": ids, "ties": ties, "asked": row["ids"].values}, words, rank


def flags_of(answers: pa.Scalar | None, edges: np.ndarray) -> np.ndarray:
    """The bits of all buckets as one array; a bucket without an answer has none set."""
    out = np.zeros(edges[-1], bool)
    for x in answers.as_py() or [] if answers is not None else []:
        a, b = edges[x["bucket"]], edges[x["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).view(bool)
    return out


def answers(found: DataFrame, name: str) -> DataFrame:
    """One row a portion: the answers of all buckets."""
    found = stored(found, name)
    return small(stored(found.groupBy("portion").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), f"spans-{name}"), 64 << 10)


def cut_flags(flags: np.ndarray, sizes: list[int], table: pa.Table) -> pa.Table:
    """The answers of a bucket: a row for each portion in which a flag is set."""
    ends = np.cumsum(sizes)
    rows = [(p, b, np.packbits(flags[e - n : e]).tobytes()) for p, b, n, e in zip(table["portion"].to_pylist(), table["bucket"].to_pylist(), sizes, ends) if flags[e - n : e].any()]
    columns = list(zip(*rows)) or [[], [], []]
    return pa.table({"portion": pa.array(columns[0], pa.int64()), "bucket": pa.array(columns[1], pa.int32()), "bits": pa.array(columns[2], pa.binary())})


ANSWER = "portion long, bucket int, bits binary"


def met_elsewhere(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<u4") for x in table["marks"].to_pylist()]
    marks = np.concatenate(parts)
    _, back, counts = np.unique(marks, return_inverse=True, return_counts=True)
    return cut_flags(counts[back] > 1, [len(x) for x in parts], table)


def _not_first(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<u8") for x in table["high"].to_pylist()]
    docs = [np.frombuffer(x, "<u4") for x in table["docs"].to_pylist()]
    ids = np.concatenate([x.values.to_numpy()[d] for x, d in zip(table["ids"], docs)])
    ties = np.concatenate([x.values.to_numpy()[d] for x, d in zip(table["ties"], docs)])
    portion = np.repeat(table["portion"].to_numpy(), [len(x) for x in parts])
    high, low = np.concatenate(parts), np.concatenate([np.frombuffer(x, "<u4") for x in table["low"].to_pylist()])
    order = np.lexsort((portion, ties, ids, low, high))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    return cut_flags(later, [len(x) for x in parts], table)


def kept_words(documents: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    portions = stored(portioned(documents, id_col, text_col), "spans-portions", compression="zstd")
    buckets = max(1, -(-(portions.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, _ in _rows(batches):
            found = Anchors(words, words.names()[0], window, buckets)
            yield found.packed(row["portion"].as_py())

    sent = portions.select("portion", "ids", "ties", "texts").mapInArrow(anchor_rows, "bucket int, portion long, marks binary")
    elsewhere = answers(sent.groupBy("bucket").applyInArrow(met_elsewhere, ANSWER), "elsewhere")

    def candidates(row: dict, words: Words, rank: np.ndarray) -> Candidates:
        names = words.names()
        anchors = Anchors(words, names[0], window, buckets)
        return Candidates(words, names, anchors.repeated(flags_of(row["elsewhere"], anchors.edges)), anchors.size, window, buckets, rank)

    def candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, rank in _rows(batches):
            found = candidates(row, words, rank)
            docs = words.doc[found.starts[found.first]].astype("<u4")
            out = []
            for b in np.flatnonzero(np.diff(found.edges)):
                at = slice(found.edges[b], found.edges[b + 1])
                own, index = np.unique(docs[at], return_inverse=True)
                out.append((b, row["portion"].as_py(), row["ids"][own], row["ties"][own], index.astype("<u4").tobytes(), found.high[at].astype("<u8").tobytes(), found.low[at].astype("<u4").tobytes()))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], names=["bucket", "portion", "ids", "ties", "docs", "high", "low"])

    told = portions.select("portion", "ids", "ties", "texts").join(elsewhere, "portion", "left")
    sent = told.mapInArrow(candidate_rows, "bucket int, portion long, ids array<long>, ties array<long>, docs binary, high binary, low binary")
    earlier = answers(sent.groupBy("bucket").applyInArrow(_not_first, ANSWER), "earlier")

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, rank in _rows(batches):
            found = candidates(row, words, rank)
            starts = found.repeats(flags_of(row["earlier"], found.edges))
            near = np.zeros(len(words.starts) + 1, np.int32)
            np.add.at(near, starts, 1)
            np.add.at(near, starts + window, -1)
            gone = np.cumsum(near[:-1]) > 0
            removed = np.bincount(words.doc[gone], minlength=len(words.counts))
            yield pa.RecordBatch.from_arrays([row["asked"], pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), _joined(words, ~gone)], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = told.join(earlier, "portion", "left").mapInArrow(kept_rows, "doc_id long, n_words long, n_removed long, kept string")
    return rows.withColumn("doc_id", F.col("doc_id").cast(documents.schema[id_col].dataType))


def _joined(words: Words, stay: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, a text for each document."""
    starts, ends, doc = words.starts[stay], words.ends[stay], words.doc[stay]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = doc[1:] == doc[:-1]  # then the white space behind a word stays, as one space
    near = np.zeros(len(words.raw) + 2, np.int8)
    near[starts] += 1
    near[ends + follows] -= 1
    held = np.cumsum(near[: len(words.raw)], dtype=np.int8).view(bool)
    out = words.raw[held]
    out[_spaces(out)] = 32
    sizes = np.bincount(doc, weights=ends - starts + follows, minlength=len(words.counts)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.counts), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
