"""Main text of web pages: structural seeds, and a suffix array over the token streams of each host.

A page is cut into blocks of text. Structure seeds what they are: blocks inside
an article (or main) element are content, those inside navigation, headers,
footers, sidebars, notices, adverts, forms, comments and the like are not, all
others are undecided. The blocks of every page make one token stream, and the
suffixes of all streams of a host, in order, show which substrings of ``LONG``
tokens or more occur on pages of different content; they may cross blocks, as a
menu of one-word blocks does. A repeated substring is boilerplate unless it lies
inside articles at least as often as outside, as shared passages and quotations
do. Undecided tokens covered by boilerplate are removed and the unique runs
between them kept; a block that is covered in part by a crossing substring
stays. The text is the content and the unique runs, in page order.

The suffix array is built in two steps, as no host may have to fit into a task:

1. Anchors, as in ``repeated_spans``: of any ``LONG`` tokens in a row that two
   streams of a host share, one aligned pair of shorter windows at cover places
   is equal. Their hashes (of host and tokens) are sent packed by bucket, and a
   bit for each comes back: met again or not.
2. The suffixes around repeated anchors are sorted, in buckets, by their first
   ``LONG`` tokens (a name of 96 bits and a bucket, made from host and tokens),
   so that those which share them are neighbours. Deeper comparison adds
   nothing: a longer common substring is the union of those that begin at its
   suffixes. A portion of pages sends a group of neighbours as one entry (least
   and largest content hash, and how often outside articles), so a passage on a
   third of all pages is one entry a portion.

Edge cases: null html has no text (an empty string); a null url is a host of
its own; pages without any tag are one block; pages of equal content (articles
and undecided blocks) count as one, whatever their ids; a page of fewer than
``LONG`` tokens repeats nothing; a page of any length is one row; unclosed
elements end with their parent or the page; an empty table gives an empty
result; other columns of the input, whatever their names, aren't returned. White
space is what Unicode calls so, a no-break space too.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import portions, stored
from cohortlens.llm.ngram_join import mixed64
from cohortlens.llm.repeated_spans import ANSWER, BUCKET_WORDS, Anchors, Words, answers, cut_flags, flags_of, hashed, met_elsewhere

#: Tokens of a substring that counts as long.
LONG = 16
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
SKIPPED = frozenset("script style noscript template head title nav header footer aside form iframe svg canvas button select textarea object dialog menu".split())
CONTENT = frozenset(("article", "main"))
#: Words in a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored sponsors banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related recommended footer header masthead topbar toolbar share sharing social "
    "comment comments commentlist replies disqus reply respond alert disclaimer copyright login signup search complementary contentinfo form".split()
)


class Blocks(HTMLParser):
    """Blocks (kind, text) of a page; kind is ``main``, ``other`` or ``skipped``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []
        self.blocks: list[tuple[str, str]] = []
        self.parts: list[str] = []

    def kind(self) -> str:
        skipped = inside = False
        for _, skip, content in self.open:
            # the outermost article isn't ruled out by what it lies in
            skipped, inside = (skipped or skip, inside) if inside or not content else (False, True)
        return "skipped" if skipped else "main" if inside else "other"

    def parse_comment(self, i, report=1):
        """The page is fed as a whole, so a comment without an end runs to the end of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((self.kind(), text))

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.cut()
        elif tag in ("br", "img", "wbr"):
            self.parts.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self.implied_end(tag)
        a = dict(attrs)
        names = " ".join(a.get(k) or "" for k in ("class", "id", "role")).lower()
        inside = any(content for _, _, content in self.open)
        skip = tag in SKIPPED and not (tag == "header" and inside) or "hidden" in a or a.get("aria-hidden") == "true"
        if tag not in ("html", "body") and not (inside and tag in INLINE):
            # inside an article a mark has to be a whole name, elsewhere a part of one will do
            skip = skip or bool(MARKS.intersection(names.split() if inside or tag in CONTENT else re.split(r"[^a-z0-9]+", names)))
        if skip and tag in INLINE:
            self.cut()
        self.open.append((tag, skip, tag in CONTENT and not skip))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def implied_end(self, tag: str) -> None:
        """A new paragraph, item or cell ends an open one of its own kind."""
        for i in range(len(self.open) - 1, -1, -1):
            other = self.open[i][0]
            if other == tag:
                self.open[i:] = [x for x in self.open[i + 1 :] if x[0] in INLINE and not x[1]]
                return
            if other not in INLINE:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in INLINE or self.open[i][1]:
                    self.cut()
                if tag in INLINE:
                    del self.open[i]
                else:
                    del self.open[i:]
                return
            if tag in INLINE and self.open[i][0] not in INLINE or self.open[i][0] in CONTENT and tag not in ("body", "html"):
                return  # closes nothing that is open within this block or article

    def handle_data(self, data):
        self.parts.append(data)


def blocks_of(html: str) -> list[tuple[str, str]]:
    """(kind, text) of each block of a page, in order; comments, scripts and markup are gone."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.blocks


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PORTIONS = "portion long, page_ids array<{}>, urls array<string>, hosts array<long>, contents array<long>, kinds array<string>, texts array<string>, n_tokens long"


def page_portions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of ``PORTIONS``: some pages each, with a hash of the host, a letter a block (m, o or s), a line of text a block, and a hash of what isn't skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in portions(batches):
            found = [blocks_of(h) for h in batch["text"]]
            said = ["\n".join(k[0] + t for k, t in blocks if k != "skipped") for blocks in found]
            texts = ["\n".join(t for _, t in blocks) for blocks in found]
            yield pd.DataFrame({
                "portion": [number], "page_ids": [[None if pd.isna(i) else i for i in batch["page_id"]]], "urls": [batch["url"].tolist()], "hosts": [[digest(h) for h in batch["host"]]], "contents": [[digest(x) for x in said]],
                "kinds": [["".join(k[0] for k, _ in blocks) for blocks in found]], "texts": [texts], "n_tokens": [sum(t.count(" ") + t.count("\n") + 1 for t in texts)],
            })
            number += 1

    kind = pages.schema[id_col].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), HOST, 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, PORTIONS.format(kind))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


class Streams:
    """The token streams of a portion's pages; a token's name holds the host, so that hosts don't meet."""

    def __init__(self, row: dict):
        self.words = Words(row["texts"].values)
        hosts = row["hosts"].values.to_numpy().view(np.uint64)
        self.names = tuple(mixed64(x ^ hosts[self.words.doc]) for x in self.words.names())
        self.contents = row["contents"].values.to_numpy()
        # blocks are lines: a token's block is known by the line ends before it
        kinds = row["kinds"].values.to_pylist()
        lines = np.concatenate(([0], np.cumsum(self.words.raw == 10)))
        offsets = self.words.offsets[self.words.doc]
        first = np.concatenate(([0], np.cumsum([len(k) for k in kinds])))[self.words.doc]
        block = first + lines[self.words.starts] - lines[offsets]
        self.main = np.frombuffer("".join(kinds).encode(), np.uint8)[block] == ord("m")


class Suffixes:
    """Suffixes of at least ``long`` tokens around repeated anchors, sorted by their first tokens' names: a bucket, then the names in it."""

    def __init__(self, of: Streams, anchors: np.ndarray, anchor_size: int, long: int, buckets: int):
        words = of.words
        near = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(near, anchors - np.minimum(words.place[anchors], long - anchor_size), 1)
        np.add.at(near, anchors + 1, -1)
        starts = np.flatnonzero(np.cumsum(near[:-1]))
        starts = starts[words.place[starts] + long <= words.counts[words.doc[starts]]]
        high, low = (hashed(of.names[i], starts, long, i + 1) for i in (0, 1))
        low &= np.uint64(0xFFFFFFFF)
        bucket = mixed64(high) % np.uint64(buckets)
        order = np.lexsort((low, high, bucket))
        self.starts, high, low = starts[order], high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.heads, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.high, self.low = high[self.heads], low[self.heads].astype(np.uint32)
        self.edges = np.searchsorted(bucket[order][self.heads], np.arange(buckets + 1))
        inside = np.concatenate(([0], np.cumsum(of.main)))
        outside = np.where(2 * (inside[self.starts + long] - inside[self.starts]) > long, -1, 1)
        content = of.contents[words.doc[self.starts]]
        none = np.zeros(0, np.int64)
        self.least, self.most, self.outside = (f.reduceat(x, self.heads) if len(order) else none for f, x in ((np.minimum, content), (np.maximum, content), (np.add, outside)))

    def hits(self, flags: np.ndarray) -> np.ndarray:
        return np.sort(self.starts[flags[self.group]])


def _boilerplate(table: pa.Table) -> pa.Table:
    """Of a bucket's suffixes those whose first tokens are on pages of different content, more often outside than inside articles."""
    parts = [np.frombuffer(x, "<u8") for x in table["high"].to_pylist()]
    high, low, least, most, outside = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("high", "<u8"), ("low", "<u4"), ("least", "<i8"), ("most", "<i8"), ("outside", "<i4")))
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    heads = np.flatnonzero(new)
    gone = (np.minimum.reduceat(least[order], heads) != np.maximum.reduceat(most[order], heads)) & (np.add.reduceat(outside[order].astype(np.int64), heads) > 0)
    flags = np.zeros(len(order), bool)
    flags[order] = gone[np.cumsum(new) - 1]
    return cut_flags(flags, [len(x) for x in parts], table)


def _kept(blocks: list[tuple[str, list[str]]], starts: list[int], long: int) -> tuple[list[str], int]:
    """The text of each block of a stream, and how many tokens outside articles repeat; a repeated substring starts at each of ``starts``.

    Content stays and what structure rules out goes. Of undecided blocks,
    substrings inside a block are cut out of it; those that cross blocks take
    the blocks that they cover wholly, and leave the others as they are.
    """
    if not starts:
        return ["" if kind == "s" else " ".join(tokens) for kind, tokens in blocks], 0
    n = sum(len(tokens) for _, tokens in blocks)
    covered, inside = bytearray(n), bytearray(n)
    ends = [e for e, (_, b) in zip(itertools.accumulate(len(b) for _, b in blocks), blocks) for _ in b]
    for i in starts:
        covered[i : i + long] = b"\x01" * long
        if i + long <= ends[i]:
            inside[i : i + long] = b"\x01" * long
    out, at, repeated = [], 0, 0
    for kind, tokens in blocks:
        gone = covered if all(covered[at : at + len(tokens)]) else inside
        here = gone[at : at + len(tokens)] if kind != "m" else bytes(len(tokens))
        out.append("" if kind == "s" else " ".join(t for t, c in zip(tokens, here) if not c))
        repeated += sum(here)
        at += len(tokens)
    return out, repeated


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", long: int = LONG) -> DataFrame:
    """page_id, url, text, n_chars and n_boiler_tokens (tokens outside articles, in blocks of whatever kind, that the host repeats as boilerplate)."""
    parsed = stored(page_portions(pages, id_col, url_col, html_col), "html-portions", compression="zstd")
    buckets = max(1, -(-(parsed.agg(F.sum("n_tokens")).first()[0] or 0) // BUCKET_WORDS))
    streams = parsed.select("portion", "hosts", "contents", "kinds", "texts")

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            of = Streams(row)
            yield Anchors(of.words, of.names[0], long, buckets).packed(row["portion"].as_py())

    sent = streams.mapInArrow(anchor_rows, "bucket int, portion long, marks binary")
    elsewhere = answers(sent.groupBy("bucket").applyInArrow(met_elsewhere, ANSWER), "elsewhere")

    def sought(row: dict) -> tuple[Streams, Suffixes]:
        of = Streams(row)
        anchors = Anchors(of.words, of.names[0], long, buckets)
        return of, Suffixes(of, anchors.repeated(flags_of(row["elsewhere"], anchors.edges)), anchors.size, long, buckets)

    def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = sought(row)[1]
            held = np.flatnonzero(np.diff(found.edges))
            columns = [(found.high, "<u8"), (found.low, "<u4"), (found.least, "<i8"), (found.most, "<i8"), (found.outside, "<i4")]
            packed = [pa.array([x[found.edges[b] : found.edges[b + 1]].astype(t).tobytes() for b in held], pa.binary()) for x, t in columns]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([row["portion"].as_py()] * len(held), pa.int64()), *packed], names=["bucket", "portion", "high", "low", "least", "most", "outside"])

    sent = streams.join(elsewhere, "portion", "left").mapInArrow(suffix_rows, "bucket int, portion long, high binary, low binary, least binary, most binary, outside binary")
    repeated = answers(sent.groupBy("bucket").applyInArrow(_boilerplate, ANSWER), "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            of, found = sought(row)
            hits = found.hits(flags_of(row["repeated"], found.edges))
            per_page = np.split(of.words.place[hits], np.searchsorted(of.words.doc[hits], np.arange(1, len(of.contents))))
            texts, boiler = [], []
            for kinds, text, own in zip(row["kinds"].values.to_pylist(), row["texts"].values.to_pylist(), per_page):
                blocks = [(k, line.split(" ")) for k, line in zip(kinds, text.split("\n"))]
                kept, repeated = _kept(blocks, own.tolist(), long)
                texts.append("\n".join(t for t in kept if t))
                boiler.append(repeated)
            yield pa.RecordBatch.from_arrays([row["page_ids"].values, row["urls"].values, pa.array(texts, pa.string()), pa.array(boiler, pa.int64())], names=["page_id", "url", "text", "n_boiler_tokens"])

    kind = pages.schema[id_col].dataType.simpleString()
    done = parsed.join(elsewhere, "portion", "left").join(repeated, "portion", "left").mapInArrow(run, f"page_id {kind}, url string, text string, n_boiler_tokens long")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boiler_tokens")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
