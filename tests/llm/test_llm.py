"""The training-data operators against brute force, libraries and round trips."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import chat, common, exact_dedup, html_main, mixing, ngram_join, quality, queries, sentencepiece_bpe, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, kept string, n_words int"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (4, "one two three four", "en", "b", 18), (4, "one two three four", "en", "b", 18),
    (None, "one  two three four", "en", "b", 19), (5, "word " * 30000, "en", "c", 150000), (6, "One two.\nOne two.\n</s> ▁ é漢😀", "en", None, 26), (7, "x", "en", "a", 1), (8, "a b c d e f g h i j k l.", "en", "a", 23),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 7, "t", "k", 9) for r in ODD]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents")


def sets_of(rows, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(low))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute_classes(rows, n, percent):
    sets = sets_of(rows, n)
    root, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def near_copies(seed, groups, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 12, 40, 120, 300]))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
            i += 1
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_classes_match_brute_force(spark, documents, n, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 5)  # groups of several blocks
    rows = near_copies(n, 12, 14) + [(10_000 + r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute_classes(rows, n, percent)
    assert len(found) == len(rows)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_jaccard_linked_sets_share_segments(percent):
    for size in range(4, 31):
        for seed in range(400 if size < 8 else 10):
            rng = np.random.default_rng(seed)
            for more in range(size + 1):
                for less in range(size - more + 1):
                    if 100 * (size - less) < percent * (size + more):
                        break
                    if not more + less:
                        continue
                    pool = rng.integers(0, 1 << 64, size + more, np.uint64)
                    two = [{b: (k, set(h.tolist())) for b, k, h in ngram_join.segments(np.sort(x), percent)} for x in (pool[:size], pool[less:])]
                    band = max(b for b in ngram_join.bands(percent, size) if b <= min(size, size + more - less))
                    assert len(two[0][band][1] & two[1][band][1]) >= max(two[0][band][0], two[1][band][0])


def test_jaccard_links_short_texts(spark):
    rng, rows = random.Random(7), []
    for i in range(0, 600, 2):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(8, 12))]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words, "end"]))]
    found = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute_classes(rows, 5, 80)


def test_jaccard_edge_cases(spark, odd):
    found = ngram_join.jaccard_classes(odd, 3, 90)
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect()]
    assert sorted(rows, key=str) == sorted([(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 2, 4, 2), (4, 2, 4, 2), (None, 2, 4, 2), (5, 1, 5, 0), (6, 5, 6, 0), (7, 1, 7, 0), (8, 10, 8, 0)], key=str)
    stay = ngram_join.representatives(odd, 3, 90)
    assert stay.columns == odd.columns and collections.Counter(r.doc_id for r in stay.collect()) in ({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 1}, {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1})
    assert ngram_join.jaccard_classes(odd.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 9), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in common.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in common.components(chain).collect()} == {0}


def water_filled(sizes, weights, share):
    goal, cap = share * sum(sizes), [2 * s for s in sizes]
    stopped = set()
    while True:
        rest = goal - sum(cap[i] for i in stopped)
        open_ = [i for i in range(len(sizes)) if i not in stopped]
        total = sum(weights[i % len(weights)] for i in open_)
        out = {i: rest * weights[i % len(weights)] / total for i in open_} | {i: cap[i] for i in stopped}
        over = {i for i in open_ if out[i] > cap[i]}
        if not over:
            return [out[i] for i in range(len(sizes))]
        stopped |= over


def test_mixing_meets_targets(spark, documents):
    rows = mixing.mix_report(documents).toPandas()
    assert len(rows) == documents.count() and (rows["taken"] <= 2 * rows["size"]).all()
    by = rows.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (by["size"] == by["source_size"]).all()
    assert np.allclose(by["target"], water_filled(by["size"].tolist(), [3, 1, 2], 1.5))
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 30).all()
    again = mixing.mix_report(documents.repartition(5)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == rows.sort_values("doc_id")["taken"].tolist()
    assert mixing.mixed(documents).count() == rows["copies"].sum()


def test_mixing_edge_cases(spark, odd):
    rows = mixing.mix_report(odd).toPandas()
    assert len(rows) == len(ODD) and rows.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(1.5 * rows["size"].sum())
    clash = odd.withColumnsRenamed({"target": "_source", "kept": "_hash", "n_words": "_times"})
    assert mixing.mixed(clash).columns == clash.columns and {tuple(r[6:]) for r in mixing.mixed(clash).collect()} == {("t", "k", 9)}
    assert mixing.mix_report(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_mixing_splits_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1)] * 40 + [(2, "a b", "x", 2)] * 3 + [(3, "c " * 500, "y", 3)] * 2, "doc_id long, text string, source string, _at int")
    rows = mixing.mix_report(docs, weights=(1.0, 1.0), share=0.05).toPandas()
    by = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(by["taken"]["x"] - by["target"]["x"]) <= 1 and len(rows) == 45
    mix = mixing.mixed(docs, weights=(1.0, 1.0), share=0.05)
    assert mix.columns == docs.columns and mix.where("source = 'x'").count() == rows[rows["source"] == "x"]["copies"].sum()


def nearest_sum(lengths, counts, budget):
    reach = {0}
    for x, n in zip(lengths, counts):
        reach = {r + k * x for r in reach for k in range(n + 1)}
    return min(abs(r - budget) for r in reach)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90) | st.integers(9_000, 90_000) | st.integers(1, 9).map(lambda x: 16 * x), st.integers(1, 5)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.floats(0, 1))
def test_fitted_is_the_best_subset(pairs, share):
    lengths, counts = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    budget = round(share * int((lengths * counts).sum()))
    taken = mixing.fitted(lengths, counts, budget)
    assert ((taken >= 0) & (taken <= counts)).all()
    assert abs(int((taken * lengths).sum()) - budget) == nearest_sum(lengths, counts, budget)


@pytest.mark.parametrize("lengths,counts,budget", [([17000, 50000, 60001], [2, 1, 1], 77001), ([32, 48], [4, 1], 128), ([10, 20, 30, 7], [10**6, 10**6, 10**6, 1], 10**7 + 4)])
def test_fitted_special_cases(lengths, counts, budget):
    taken = mixing.fitted(np.array(lengths), np.array(counts), budget)
    assert abs(int((taken * np.array(lengths)).sum()) - budget) == (3 if len(lengths) == 4 else 0)


def test_warc_round_trip(spark):
    pages = common.table(spark, SF, "pages")
    tricky = [(-1, None, None), (-2, "http://a b", "x\r\n\r\nWARC/1.1\r\n" * 200), (None, None, "q" * 2000), (-3, "u", "q" * 2000), (-4, "u", "é" * 600), (-5, "u", "é" * 600), (-6, "u", "s"), (-7, "u", "s")]
    pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 100_000)).unionByName(spark.createDataFrame(tricky, pages.schema)).withColumn("payload_digest", F.lit(1))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    best = {}
    for i, b in rows:
        if len(b) >= 1000 and i is not None:
            best[b] = max(i, best.get(b, i))
    want = [(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if best.get(b, i) != i else "response", best[b] if best.get(b, i) != i else None) for i, b in rows]
    found = [tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "u", "0123456789\r\n\r\n" * 300_000), (2, "u", "0123456789\r\n\r\n" * 300_000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.round_trip(long).collect()) == [(1, 4_200_000, 2), (2, 4_200_000, None)]


def test_warc_rewrite_resolves_again(spark):
    pages = spark.createDataFrame([(1, "u", "p" * 1500), (2, "u", "p" * 1500), (3, "v", "short")], "page_id long, url string, html string")
    first, second = common.new_path(spark, "w1"), common.new_path(spark, "w2")
    warc.write_archives(pages, first, least_bytes=1 << 30)
    assert warc.read_records(spark, first).where("record_type = 'revisit'").count() == 0
    warc.rewrite(spark, first, second)
    assert {tuple(r)[:1] + tuple(r)[3:] for r in warc.joined_revisits(warc.read_records(spark, second)).collect()} == {(1, "revisit", 2), (2, "response", None), (3, "response", None)}


def test_warc_hot_payloads_beyond_the_broadcast(spark):
    """A payload of a third of all rows drops its revisits before the shuffle; the rest goes by digest; nothing changes."""
    rows = [(i, "u", "hot" * 500 if i % 3 == 0 else f"{i % 700:05d}" * 300) for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    header_rows = common.stored(warc.headers(pages), "t-headers")
    shared = common.stored(warc.originals(header_rows), "t-shared")
    apart, sent = (warc.responses(header_rows, shared, 6000, b) for b in (0, 1 << 20))
    best = {}
    for i, _, text in rows:
        best[text] = i
    want = sorted(best.values())
    assert sorted(r.page_id for r in apart.collect()) == sorted(r.page_id for r in sent.collect()) == want
    again = {r.page_id: r.refers_to for r in warc.revisits(header_rows, shared, 6000).collect()}
    assert again == {i: best[t] for i, _, t in rows if best[t] != i}
    found = {r.page_id: r.refers_to for r in warc.round_trip(pages).collect()}
    assert found == {i: again.get(i) for i, _, _ in rows}


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "KINDS", (100, 1000, 4000))
    monkeypatch.setattr(warc, "FILE_BYTES", 8000)
    sizes = [0, 100, 101, 1000, 1001, 4000, 4001, 9000] * 25
    pages = spark.createDataFrame([(i, "u", f"{i:03d}".ljust(n, ".")[:n]) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    path = common.new_path(spark, "kinds")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").collect()
    held = [[len(b.partition(b"\r\n\r\n")[2]) for _, b in warc.parsed(warc._unzipped(bytes(f.content)))] for f in files]
    assert sorted(n for h in held for n in h) == sorted(sizes)
    assert all(sum(h) <= 8000 or len(h) == 1 for h in held) and max(map(len, held)) == 50
    assert {r.page_id: r.payload_bytes for r in warc.joined_revisits(warc.read_records(spark, path)).collect()} == dict(enumerate(sizes))


def test_warc_rewrite_of_revisits(spark):
    """A former revisit becomes a response with its payload, others stay without one; a lost response leaves an empty record."""
    pages = spark.createDataFrame([(1, "u", "p" * 1500), (2, "v", "p" * 1500), (4, "w", "q" * 1200), (5, None, "q" * 1200)], "page_id long, url string, html string")
    first, second, alone = (common.new_path(spark, n) for n in ("w1", "w2", "w3"))
    warc.write_archives(pages, first)
    warc.rewrite(spark, first, second, least_bytes=1300)
    found = {r.page_id: (r.record_type, r.refers_to, r.url, r.payload_bytes) for r in warc.joined_revisits(warc.read_records(spark, second), "url").collect()}
    assert found == {1: ("revisit", 2, "u", 1500), 2: ("response", None, "v", 1500), 4: ("response", None, "w", 1200), 5: ("response", None, None, 1200)}
    bodies = {r.page_id: bytes(r.payload) for r in warc.read_records(spark, second, payloads=True).where("record_type = 'response'").collect()}
    assert bodies == {2: b"p" * 1500, 4: b"q" * 1200, 5: b"q" * 1200}
    warc.rewrite(spark, f"{first}/revisits", alone)
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.read_records(spark, alone).collect()) == [(1, "response", 0), (4, "response", 0)]


def test_sharding(spark, documents):
    rows = sharding.feistel_shards(documents).toPandas()
    texts = {r.doc_id: r.text for r in documents.collect()}
    counts = rows.groupby("shard").size()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert all(zlib.crc32(texts[i].encode()) == c and len(texts[i].encode()) + 8 == s for i, c, s in zip(rows["doc_id"], rows["text_crc32"], rows["size"]))
    again = sharding.feistel_shards(documents.repartition(7)).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


@pytest.mark.parametrize("n", [1, 2, 5, 97, 1000])
def test_feistel_is_a_bijection(spark, n):
    rows = spark.range(n)
    shard, slot = sharding.address(F.col("id"), n, 7)
    back = rows.select("id", shard.alias("s"), slot.alias("t")).withColumn("row", sharding.row_at(F.col("s"), F.col("t"), n, 7)).collect()
    assert len({(r.s, r.t) for r in back}) == n and all(r.id == r.row for r in back)


def test_sharding_edge_cases(spark, odd):
    rows = sharding.feistel_shards(odd, shards=3).collect()
    assert len(rows) == len(ODD) and sorted(r.row_number for r in rows) == list(range(len(ODD)))
    assert sharding.feistel_shards(odd.limit(0)).count() == 0


def test_exact_dedup(spark, odd, documents):
    plain = documents.select("doc_id", "text").unionByName(documents.select((F.col("doc_id") + 5000).alias("doc_id"), F.regexp_replace("text", " ", " \t").alias("text")).limit(50))
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in plain.collect()}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    want = {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    for hash_of in (exact_dedup.content_hash, lambda t: F.substring(F.md5(F.encode(t, "UTF-8")), 1, 1)):  # the weak one clashes everywhere
        assert {tuple(r) for r in exact_dedup.exact_groups(plain, hash_of=hash_of).collect()} == want
    assert {r.doc_id for r in exact_dedup.deduplicated(plain).collect()} == {w[0] for w in want if w[3]}
    assert sum(r.kept for r in exact_dedup.exact_groups(odd).collect()) == exact_dedup.deduplicated(odd).count() == 7
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_sentencepiece_matches_the_library(spark, documents, odd):
    of = sentencepiece_bpe.pieces(queries.model_path())
    for docs in (documents, odd):
        found = {(r.doc_id, r.decoded): r for r in sentencepiece_bpe.encoded(docs, queries.model_path(), texts=True).collect()}
        for r in docs.collect():
            ids = of.library.encode(r.text or "", add_eos=True)
            text = of.library.decode(ids)
            got = found[r.doc_id, text]
            assert list(got.ids) == ids and got.n_tokens == len(ids)
            assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sentencepiece_bpe.encoded(odd.limit(0), queries.model_path()).count() == 0
    rows = spark.createDataFrame([(of.library.encode("né \n漢 x", add_eos=True),), (None,)], "ids array<int>")
    assert [r.decoded for r in sentencepiece_bpe.decoded_texts(rows, queries.model_path()).collect()] == ["né \n漢 x", None]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "th", "ing", " ", "  ", "▁", "\n", "\t", "é", "ß", "漢", "😀", "\x00", "0", "</s>", "<0x41>", "rrrr", "supercalifragilistic" * 3]), max_size=40).map("".join))
def test_agenda_matches_the_library(text):
    of = sentencepiece_bpe.pieces(queries.model_path())
    ids = [i for w in sentencepiece_bpe.words_of(text) for i in of.ids(w)]
    assert ids == of.library.encode(text)
    assert of.decoded([*ids, of.end]) == of.library.decode([*ids, of.end])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=25))
def test_decoding_any_ids(ids):
    of = sentencepiece_bpe.pieces(queries.model_path())
    assert of.decoded(ids) == of.library.decode(ids)


def test_quality_measures(spark, documents, odd):
    for docs in (documents, odd):
        for r in quality.measured(docs).collect():
            text = r.text or ""
            words = WORDS.findall(text)
            windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            often, covered = collections.Counter(windows), set()
            for i, w in enumerate(windows):
                if often[w] > 1:
                    covered.update(range(i, i + 5))
            lines = [x for x in text.split("\n") if WORDS.search(x)]
            base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
            want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
            assert not (base and r.kept)
    clash = odd.withColumnsRenamed({"size": "lost_chars", "target": "_row"})
    stay = quality.kept_documents(clash)
    assert stay.columns == clash.columns and {tuple(r[5:]) for r in stay.collect()} == {(7, "t", "k", 9)}
    assert quality.measured(odd.limit(0)).count() == quality.kept_documents(odd.limit(0)).count() == 0
    again = quality.measured(odd.unionByName(odd)).collect()
    assert len(again) == 2 * len(ODD)


def failing_line(line):
    """The line rules once more, word by word."""
    words = WORDS.findall(line)
    if not words:
        return False
    capitals = re.compile("[A-ZÀ-ÖØ-Þ]")
    suspect = re.search("[#*$%&<>|›»·•!]|[A-ZÀ-ÖØ-Þ]{4}", line)
    bars = sum(all(c in "|›»·•>" for c in w) for w in words)
    loud = 2 * line.count("!!") > len(words) or (re.search("[A-ZÀ-ÖØ-Þ]{4}", line) and len(words) >= 5 and 2 * len(capitals.findall(line)) > len(line))
    return bool(
        not any(c in line for c in ".!?…。！？")
        or (len(line) <= quality.PHRASE_CHARS and any(x in line.lower() for x in quality.PHRASES))
        or (suspect and (5 * bars >= len(words) or 2 * len(re.findall(quality.SYMBOLS, line)) > len(words) or loud))
    )


def test_quality_verdicts_match_brute_force(spark, documents, odd):
    rng = random.Random(4)
    bits = ["Home", "|", "»", "News.", "!!", "BUY NOW", "###", "$5", "a plain word or two.", "read more", "Alle Rechte vorbehalten.", "\t", "ÄRGER ÜBER", "x", "We said so; it was so.", ""]
    made = spark.createDataFrame([(10_000 + i, "\n".join(" ".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 9)))) for i in range(300)], "doc_id long, text string")
    for docs in (documents, odd, made):
        for r in quality.measured(docs).collect():
            text = r.text or ""
            lines = text.split("\n")
            lost = sum(len(x) for x in lines if failing_line(x))
            assert r.lost_chars == lost and r.kept == (not r.base_failed and 100 * lost <= 50 * len(text))
            assert r.cleaned == (r.text if lost == 0 else "\n".join(x for x in lines if not failing_line(x)))


def test_quality_lines(spark):
    lines = {"Plain prose ends here.": False, "Home | News | About | Contact.": True, "no sentence mark at all": True, "BUY!! NOW!! CHEAP!! PILLS.": True, "All rights reserved.": True, "a%%% b$$$ c*** d.": True, "": False, "It cost 50% less, she said.": False}
    df = spark.createDataFrame([(k,) for k in lines], "x string")
    assert {r.x: r.f for r in df.select("x", quality.fails(F.col("x")).alias("f")).collect()} == lines


def test_quality_keeps_good_documents(spark):
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").df()
    rows = quality.measured(common.table(spark, "/root/testdata/sf0.01", "documents")).select("doc_id", "base_failed", "kept").toPandas().merge(labels, on="doc_id")
    judged = rows[~rows["base_failed"]]
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.99 and judged[judged["quality"] == 0]["kept"].mean() < 0.1


def test_chat_round_trip(spark):
    rows = common.table(spark, SF, "conversations")
    tricky = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "user", None), (-8, 1, "assistant", 'a\\<s>[\\ROLE]<\\\\s> "q"\n 😀[/ROLE]'), (-8, 2, None, "<|im_end|>"), (-9, 0, "assistant", ""), (-10, None, "a</s>b[/ROLE]", ""), (None, 1, "assistant", "x</s>")]
    rows = rows.unionByName(spark.createDataFrame(tricky, rows.schema)).withColumn("record", F.lit("clash"))
    found = {r.conv_id: r for r in chat.digests(chat.formatted_conversations(chat.conversation_records(rows))).collect()}
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    assert found.keys() == by.keys()
    for k, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{a}\n{b}\n" for _, a, b in turns), "".join(b for _, a, b in turns if a == "assistant")
        r = found[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_layouts_of_conversations(spark):
    """Every layout comes up, and whatever the layout, the turns read back are those of the conversation."""
    rows, want = [], {}
    shapes = [("user", "assistant"), ("system", "user", "assistant"), ("user", "assistant", "user"), ("human", "gpt"), ("system", "user"), ("system",), ("assistant", "user")]
    for i in range(24 * len(shapes)):
        roles = shapes[i % len(shapes)]
        said = [(r, f"</s> {i} <s>[ROLE]{k}" if i % 5 else "") for k, r in enumerate(roles)]
        want[i] = said
        rows += [(i, k, r, t) for k, (r, t) in enumerate(said)]
    records = chat.assorted_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = chat.formatted_conversations(records.withColumn("layout", F.lit("clash")).withColumn("kept", F.lit(1)))
    assert {"conv_id", "kept", "layout", "fingerprint", "mapped", "formatted", "loss_spans"} == set(done.columns)
    found = done.withColumn("read", chat.read_back(F.col("formatted"))).collect()
    assert {r.layout for r in found} == {m.name for m in chat.MAPPINGS} and all(r.mapped for r in found)
    assert {r.conv_id: [tuple(t) for t in r.read] for r in found} == want
    for r in chat.digests(done).collect():
        assert r.formatted_chars == len(next(x.formatted for x in found if x.conv_id == r.conv_id))


def test_chat_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    none = spark.createDataFrame([], schema)
    assert chat.digests(chat.formatted_conversations(chat.assorted_records(none))).count() == 0
    long = "</s>[INST] word " * 100_000
    rows = spark.createDataFrame([(1, 0, "user", long, "x"), (1, 1, "assistant", long, "x"), (1, 1, "assistant", long, "x"), (None, 0, None, None, "x")], schema)
    found = {r.conv_id: r for r in chat.digests(chat.formatted_conversations(chat.assorted_records(rows))).collect()}
    assert found[1].n_turns == 3 and found[1].loss_chars == 2 * len(long) and found[None].n_turns == 1 and found[None].loss_chars == 0


def test_chat_layouts(spark):
    cases = [
        ('{"prompt":"a","completion":"b"}', [("user", "a"), ("assistant", "b")]),
        ('{"id":3,"instruction":"i","input":"","output":"o"}', [("user", "i"), ("assistant", "o")]),
        ('{"instruction":"i","input":"n","output":"o"}', [("user", "i"), ("user", "n"), ("assistant", "o")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', [("user", "q"), ("assistant", "a")]),
        ('{"data":{"prompt":"p","response":null}}', [("user", "p"), ("assistant", "")]),
        ('{"messages":[]}', []), ('{"x":1}', None), ("[1", None), (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, record string")
    for r in chat.canonical_turns(df).collect():
        want = cases[r.i][1]
        assert r.mapped == (want is not None) and [tuple(t) for t in r.turns] == (want or [])


def test_html_blocks():
    parts = html_main.blocks_of('<p>a<p>b <i>c</i>d&amp;<br>e<ul><li>x<li>y</ul><div class="comments">z</div>w <!-- q --> <a hidden>u</a>k<script>s</script>')
    assert [t for k, t in parts if k == "other"] == ["a", "b cd& e", "x", "y", "w", "k"]
    parts = html_main.blocks_of('<nav>n</nav><article><h1>T</h1>x<div class="ad">ad<p>in</div>y<footer>f</footer></article>z')
    assert [t for k, t in parts if k == "main"] == ["T", "x", "y"] and ("other", "z") in parts


PAGES = "page_id long, url string, html string"


def sorted_suffixes(rows, long):
    """Text of each page by a whole suffix array for each host, its neighbours compared token by token."""
    pages, hosts = {}, collections.defaultdict(list)
    for i, url, source in rows:
        blocks = html_main.blocks_of(source or "")
        content = tuple(b for b in blocks if b[0] != "skipped")
        pages[i] = (blocks, set())
        tokens = [(t, k) for k, text in blocks for t in text.split(" ")]
        host = (re.match("[a-z]+://([^/]*)", url or "") or ["", ""])[1]
        hosts[host] += [([t for t, _ in tokens[s:]], content, i, s, sum(k == "main" for _, k in tokens[s : s + long])) for s in range(len(tokens) - long + 1)]
    for array in hosts.values():
        array.sort(key=lambda x: x[0])
        first = 0
        for k in range(1, len(array) + 1):
            common = 0
            if k < len(array):
                common = next((n for n, (x, y) in enumerate(zip(array[k - 1][0], array[k][0])) if x != y), min(len(array[k - 1][0]), len(array[k][0])))
            if common < long:
                group, first = array[first:k], k
                if len({g[1] for g in group}) > 1 and sum(-1 if 2 * g[4] > long else 1 for g in group) > 0:
                    for _, _, i, s, _ in group:
                        pages[i][1].add(s)
    out = {}
    for i, (blocks, hits) in pages.items():
        place, said = 0, []
        for kind, text in blocks:
            tokens = text.split(" ")
            mine = range(place, place + len(tokens))
            by_all = [any(h <= p < h + long for h in hits) for p in mine]
            by_inner = [any(place <= h <= p < h + long <= place + len(tokens) for h in hits) for p in mine]
            place += len(tokens)
            gone = by_all if all(by_all) else by_inner
            said.append("" if kind == "skipped" else text if kind == "main" else " ".join(t for t, g in zip(tokens, gone) if not g))
        out[i] = "\n".join(x for x in said if x)
    return out


def test_html_matches_sorted_suffixes(spark):
    rng = random.Random(3)
    shared = [" ".join(rng.choices("abcdefghij", k=rng.randint(6, 40))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            said = rng.choice(shared) if rng.random() < 0.6 else " ".join(rng.choices("abcdefghij", k=rng.randint(1, 20)))
            if rng.random() < 0.2:
                said += " " + rng.choice(shared)
            parts.append(rng.choice(["<div>{}</div>", "<div>{}</div>", "<nav>{}</nav>", "<article><p>{}</p></article>"]).format(said))
        rows.append((i, f"http://{rng.choice('xyz')}.example/{i}", "".join(parts)))
    for long in (4, 8, 16):
        found = {r.page_id: r.text for r in html_main.main_texts(spark.createDataFrame(rows, PAGES), long=long).collect()}
        assert found == sorted_suffixes(rows, long)


def test_html_host_boilerplate(spark):
    boiler = "one two three four five six seven eight nine"
    rows = [(i, f"http://h.example/{i}", f"<div>{boiler}</div><div>own text {i} is here</div>") for i in range(3)]
    rows += [(7, "http://other.example/", f"<div>{boiler}</div>"), (8, "http://h.example/8", f"<article><p>{boiler}</p></article><div>{boiler}</div><div>said once</div>"), (9, None, None), (10, "http://h.example/10", f"<div>{boiler} tail</div>")]
    rows += [(i, f"http://quoted.example/{i}", f"<article>{boiler}</article>") for i in (20, 21)] + [(22, "http://quoted.example/22", f"<div>{boiler}</div>")]
    found = {r.page_id: r.text for r in html_main.main_texts(spark.createDataFrame(rows, PAGES), long=8).collect()}
    assert found == {0: "own text 0 is here", 1: "own text 1 is here", 2: "own text 2 is here", 7: boiler, 8: f"{boiler}\nsaid once", 9: "", 10: "tail", 20: boiler, 21: boiler, 22: boiler}


def test_html_menus_and_copies(spark):
    menu = "".join(f"<div>{w}</div>" for w in "Home About News Sports Weather Travel Food Contact Help".split())
    nav = "<nav>zero one two three four five six seven eight nine</nav>"
    own = "<p>this page says quite a lot of its own things {}</p>"
    rows = [(i, f"http://h.example/{i}", f"{menu}<p>text of its own {i}</p>") for i in range(3)]
    rows += [(i, f"http://copy.example/{i}", own.format(1)) for i in (10, 11)] + [(12, "http://copy.example/12", own.format(1) + nav)]
    rows += [(20, "http://mixed.example/20", f"{menu}<article>first</article>"), (21, "http://mixed.example/21", menu), (22, "http://mixed.example/22", f"<div>unlike</div>{menu}")]
    found = {r.page_id: (r.text, r.n_boiler_tokens) for r in html_main.main_texts(spark.createDataFrame(rows, PAGES), long=8).collect()}
    said = own.format(1)[3:-4]
    assert found == {i: (f"text of its own {i}", 9) for i in range(3)} | {i: (said, 0) for i in (10, 11, 12)} | {20: ("first", 9), 21: ("", 9), 22: ("unlike", 9)}


def test_html_edge_cases(spark):
    clash = "page_id long, url string, html string, host string, blocks string, _row int, content int"
    rows = [(1, None, "", "h", "b", 1, 2), (None, "u", "<p>x" * 3, "h", "b", 1, 2), (2, "http://a.example", "<div>" + "many words " * 60_000 + "</div>", "h", "b", 1, 2), (2, "http://a.example", "<div>" + "many words " * 60_000 + "</div>", "h", "b", 1, 2)]
    found = html_main.main_texts(spark.createDataFrame(rows, clash))
    assert sorted((r.page_id or 0, r.n_chars) for r in found.collect()) == [(0, 5), (1, 0), (2, 659_999), (2, 659_999)]
    empty = html_main.main_texts(spark.createDataFrame([], clash))
    assert empty.columns == found.columns and empty.count() == 0


def test_html_articles_are_whole(spark):
    pages = common.table(spark, SF, "pages")
    for r in html_main.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(x.split()) for x in re.split("<[^>]*>", article)]
        assert r.text.split() == html.unescape(" ".join(want)).split()
        assert r.n_chars == len(r.text)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = common.table(spark, sf, "labels")
    rows = toxicity.scored(common.table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8), toxicity.fitted(common.table(spark, sf, "documents"), labels))
    held = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95 and held[held["toxic"] == 1]["predicted"].mean() > 0.75


def test_toxicity_reads_disguises(spark):
    counts = toxicity.trigram_counts(common.table(spark, SF, "documents")).toPandas()
    english = spark.createDataFrame([("idiot stupid moron trash loser worthless the and is it that pathetic scum " * 300,)], "text string")
    more = toxicity.trigram_counts(english).toPandas()
    both = counts.set_index("trigram")["n"].add(more.set_index("trigram")["n"], fill_value=0)
    logp = toxicity.log_probabilities(both.index.to_numpy(), both.to_numpy())
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("idiooooot", "idiot"), ("i d i o t", "idiot"), ("s.c.u.m", "scum"), ("st*pid", "stupid"), ("tr@$h", "trash")):
        assert word in toxicity.restored(token, logp)
    assert toxicity.restored("plain,", logp) == ["plain"]


def test_toxicity_decodes_as_all_readings_do():
    rng = np.random.default_rng(5)
    for _ in range(3):
        logp = np.log(rng.dirichlet(np.full(toxicity.SYMBOLS, 0.3), (toxicity.SYMBOLS, toxicity.SYMBOLS)) + 1e-9)
        for _ in range(150):
            token = "".join(rng.choice(list("abeio013!|@$*.-xx"), rng.integers(1, 8)))
            read = toxicity.decoded(token, logp)
            groups = [(c, len(list(g))) for c, g in itertools.groupby(token)]
            options = [toxicity._readings(c, run, 0 < k < len(groups) - 1) for k, (c, run) in enumerate(groups)]
            scores = collections.defaultdict(lambda: -1e300)
            for way in itertools.product(*options):
                symbols = [0, 0, *(toxicity._symbol(x) for out, _ in way for x in out), 0]
                said = "".join(out for out, _ in way)
                scores[said] = max(scores[said], sum(c for _, c in way) + sum(logp[a, b, c] for a, b, c in zip(symbols, symbols[1:], symbols[2:])))
            assert scores[read] == pytest.approx(max(scores.values()))


def test_toxicity_edge_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.0}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_feistel_matches_plain_python(spark):
    """The permutation again, a number at a time; only the round function is Spark's own hash."""
    for n in (1, 7, 60, 350):
        a, b = sharding._grid(n)
        tables = spark.range(max(a, b)).select("id", *[sharding._mixed(F.col("id"), 11, k, b if k % 2 else a).alias(f"f{k}") for k in range(sharding.ROUNDS)]).orderBy("id").collect()

        def step(x):
            left, right = divmod(x, b)
            for k in range(0, sharding.ROUNDS, 2):
                left = (left + tables[right][f"f{k}"]) % a
                right = (right + tables[left][f"f{k + 1}"]) % b
            return left * b + right

        def walked(x):
            x = step(x)
            while x >= n:
                x = step(x)
            return x

        shard, slot = sharding.address(F.col("id"), n, 5, 11)
        for r in spark.range(n).select("id", shard.alias("s"), slot.alias("t")).collect():
            assert (r.t, r.s) == divmod(walked(r.id), 5)


def test_pipeline_edge_cases(spark, odd):
    """Each stage on odd rows, repeated rows, clashing columns and an empty table."""
    import corpus_pipeline

    good = "It was a plain day, and nobody in the village had much to say about any of it. " * 3
    more = [(100 + i, good + f"Number {i % 2} ends here.", "en", "a", 5, 7, "t", "k", 9) for i in (0, 0, 1, 2)] + [(None, good, "en", None, 5, 7, "t", "k", 9)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).withColumnsRenamed({"size": "_id", "target": "_source", "kept": "_row", "n_words": "said"})
    for start in (docs, docs.limit(0)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = common.stored(stage(spark, now, SF), "test-odd")
            assert k == 4 or now.columns == docs.columns
            assert now.count() == 0 or start is docs
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    stay = ngram_join.representatives(spark.createDataFrame([(1, good), (1, "Another text altogether, with words of its own, many of them new."), (None, good + "End."), (2, good), (2, good)], "doc_id long, text string"))
    assert sorted(r.text[:7] for r in stay.collect()) == ["Another", "It was "] and {r.doc_id for r in stay.collect()} == {1}


def test_pipeline(spark):
    import corpus_pipeline

    docs, seen = common.table(spark, SF, "documents"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.stored(stage(spark, docs, SF), "test-pipeline")
        seen.append(docs.count())
        assert k == 4 or docs.columns == columns
        if k == 2:
            kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert all(v[2] == 0 for v in brute_classes(kept, 5, 80).values())
    assert seen[0] > seen[1] >= seen[2] > 0 and seen[3] == seen[4]
    kept = len(common._stored)
    assert corpus_pipeline.run(spark, SF).count() == seen[4] and len(common._stored) == kept
