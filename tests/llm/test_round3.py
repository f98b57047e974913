"""Fill-in-middle, whitening and repeated passages against brute force."""

import hashlib
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import common, fill_in_middle, html_main, queries, repeated_spans, sharding, whitening

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, n int, form string, output string, kept string, id int, portion int"


def odd(spark, rows):
    return spark.createDataFrame([(*r, 7, "f", "o", "k", 1, 2) for r in rows], CLASHING)


def same_rows(found, sql, sf_dir, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = db.execute(sql)
    names = [c[0] for c in theirs.description]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(([r[c] for c in names] for r in found), key=key) == sorted(([*r] for r in theirs.fetchall()), key=key)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_repeated_spans"])
def test_queries_equal_their_sql(spark, name):
    same_rows(queries.registered()[name](spark, SF).collect(), queries.ORACLE_SQL[name], SF, ["documents"])


# ---- fill in middle


def brute_cut(doc_id, text):
    tokens = TOKENS.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n, text = len(tokens), text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_cuts_equal_brute_force_and_texts_come_back(spark):
    rng = random.Random(5)
    alphabet = ["a", "ß", "漢", "😀", " ", "\n", "\t", " ", "\x1c", "<", ">", "P", "S", "\x0b"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "no id here"), (1, None), (2, ""), (3, " \t\n"), (4, "has <S> inside"), (5, "has <P> inside"), (6, "x" * 100_000 + " y" * 50_000), (7, "twice the same"), (7, "twice the same"), (8, "<" * 9), (9, "<<P <P< S>")]
    done = fill_in_middle.fill_in_middle(odd(spark, rows))
    found = done.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(i, *brute_cut(i, t), t or "") for i, t in rows]
    assert sorted([tuple(r) for r in found], key=key) == sorted(want, key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_cut_of_an_empty_table(spark):
    assert fill_in_middle.fill_in_middle(odd(spark, [])).collect() == []


@given(st.text(alphabet=" \t\nab漢😀\x0b\x85", max_size=30))
@settings(max_examples=200, deadline=None)
def test_boundaries_are_token_ends(text):
    ends = np.cumsum([0, *map(len, TOKENS.findall(text))])
    assert fill_in_middle.boundaries(fill_in_middle.code_points(text)).tolist() == ends.tolist()


def test_other_seed_and_marks(spark):
    docs = spark.createDataFrame([(i, f"one two {i} four five") for i in range(200)], "key long, body string")
    done = fill_in_middle.fill_in_middle(docs, "key", "body", seed=7, cut_percent=100, spm_percent=0, marks=("[pre]", "[suf]", "[mid]"))
    back = done.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert {r.form for r in back} == {"psm"} and all(r.back == f"one two {r.doc_id} four five" and r.output.startswith("[pre]") for r in back)
    assert {r.doc_id: r.output for r in done.collect()} == {r.doc_id: r.output for r in fill_in_middle.fill_in_middle(docs.repartition(7), "key", "body", 7, 100, 0, ("[pre]", "[suf]", "[mid]")).collect()}


# ---- whitening


def brute_whitening(rows, k=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dim)]
    far = {x: [n * a - s for a, s in zip(x, sums)] for x in {tuple(x) for _, x in kept}}
    centred = np.array([[c / n for c in far[x]] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = Fraction(sum(c * c for x in fit for c in far[x]), n**3)
    return {(i, j + 1): (n, sum(c * c for c in far[tuple(x)]), np.array(far[tuple(x)]) / n @ vectors[:, j] / math.sqrt(values[j]), values[j] / float(total)) for i, x in kept for j in range(len(values)) if values[j] > 1e-12 * values[0]}


def same_whitening(found, want):
    assert sorted((r.vec_id, r.component) for r in found) == sorted(want)
    sign = {}
    for r in found:
        n, far, value, share = want[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, far) and abs(r.explained - share) <= 1e-9 * share and r.identity_error <= 1e-9
        if abs(value) > 1e-3:
            assert sign.setdefault(r.component, np.sign(r.whitened * value)) == np.sign(r.whitened * value)
        assert abs(abs(r.whitened) - abs(value)) < 1e-8


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[i % 3].tolist()) for i in range(50)]
    bad = [(2000, None), (2001, [1.0] * 19 + [None]), (2002, [1.0] * 19 + [float("nan")]), (2003, [1.0] * 19 + [float("-inf")]), (2004, []), (2005, [1.0])]
    frame = spark.createDataFrame([(i, v, 1, "d") for i, v in rows + bad], "vec_id long, embedding array<float>, n int, deviation string")
    same_whitening(whitening.whitened(frame).collect(), brute_whitening(rows))


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in common.table(spark, SF, "embeddings").collect()]
    found = queries.op12_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == dict(found.dtypes)["n"] == "bigint" and dict(found.dtypes)["component"] == "int"
    same_whitening(found.collect(), brute_whitening(rows))


def test_whitening_without_spread(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(frame([])).collect() == []
    assert whitening.whitened(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    flat = whitening.whitened(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(None, [3.0, 6.0, 5.0])])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 10 and all(r.identity_error < 1e-9 and abs(r.explained - 1) < 1e-12 for r in flat)
    with pytest.raises(Exception, match="integer grid"):
        whitening.whitened(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()


# ---- repeated passages


def brute_spans(rows, window):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("period", sorted(repeated_spans.COVERS))
def test_covers_hold_every_distance(period):
    places = repeated_spans.COVERS[period]
    assert {(a - b) % period for a in places for b in places} == set(range(period))


def planted(seed, documents, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["漢字", "a b", "long" * 20, "long" * 20 + "x", "\x00", "z\x00"]
    passages = [rng.choices(words, k=rng.choice([19, 20, 21, 33, 60])) for _ in range(12)]
    rows = []
    for i in rng.sample(range(10 * documents), documents):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choices(words, k=rng.randint(0, 30)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t "]) for w in parts)))
    return rows


@pytest.mark.parametrize("window,vocabulary", [(20, 500), (20, 2), (7, 30), (2, 30), (1, 5), (50, 2)])
def test_repeats_equal_brute_force(spark, window, vocabulary, monkeypatch):
    monkeypatch.setattr(repeated_spans, "PORTION", 1500)
    monkeypatch.setattr(repeated_spans, "BUCKET_WORDS", 700)
    rows = planted(window, 120, vocabulary)
    rows += [(-5, None), (-4, ""), (-3, " \n"), (5000, rows[3][1]), (5001, rows[3][1]), (-9, "same " * 500), (9000, " ".join(map(str, range(4000))) * 2)]
    found = repeated_spans.kept_words(odd(spark, rows).repartition(6), window).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute_spans(rows, window))


def test_repeats_of_equal_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(repeated_spans, "PORTION", 10)
    text = " ".join(f"t{i}" for i in range(25))
    rows = [(None, text), (3, text), (3, text), (2, "short"), (None, None)]
    found = repeated_spans.kept_words(odd(spark, rows).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in found), key=str) == sorted([(None, 25, 25), (3, 25, 0), (3, 25, 25), (2, 1, 0), (None, 0, 0)], key=str)
    assert repeated_spans.kept_words(odd(spark, [])).collect() == []


def test_answers_that_are_too_large_to_send_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(repeated_spans, "PORTION", 3000)
    rows = planted(8, 60, 40)
    found = repeated_spans.kept_words(odd(spark, rows).repartition(3)).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute_spans(rows, 20))


# ---- pages


@pytest.mark.parametrize(
    "page,text",
    [
        ('<div class="layout no-sidebar"><nav>Menu</nav><article><p>Body text.</p></article></div>', "Body text."),
        ("<form action='/'><input><article><p>Body text.</p></article><p>Send</p></form>", "Body text."),
        ('<article><div class="article-header"><h1>Title</h1></div><p>Body.</p></article>', "Title\nBody."),
        ('<article><p class="notice-period">Three months.</p><p>See the <a class="reply">letter</a>.</p></article>', "Three months.\nSee the letter."),
        ('<article><p>Body.</p><div class="comments"><article class="comment"><p>First!</p></article></div><div class="ad"><p>Buy</p></div></article>', "Body."),
        ('<section class="comments"><article class="comment"><p>First!</p></article></section><article><p>Body.</p></article>', "Body."),
        ("<article><p>Body.</p></article><!-- not closed <p>leak</p> <article>leak</article>", "Body."),
        ("<article><p>One.</p><!-- a --><p>Two.</p><!----><p>Three.</p></article>", "One.\nTwo.\nThree."),
    ],
)
def test_articles_within_marked_wrappers_and_comments(page, text):
    assert "\n".join(t for k, t in html_main.blocks_of(page) if k == "main") == text


def test_repeats_are_sought_on_pages_with_articles(spark):
    legal = " ".join(f"clause{i}" for i in range(40))
    rows = [(i, "http://h.org/a", f"<article><p>Story {i} about thing{i}.</p></article><div>{legal}</div><p>own words {i}</p>") for i in range(5)]
    found = html_main.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id} about thing{r.page_id}.\nown words {r.page_id}" and r.n_boiler_tokens >= 40 for r in found)


def test_equal_rows_are_numbered_over_several_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = common.stored(spark.range(20_000).select(F.when(F.col("id") < 19_900, 7).otherwise(F.col("id")).alias("k")), "equal")
        numbered, n = sharding.row_numbered(rows, ["k"])
        most = numbered.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        found = numbered.orderBy("row_number").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n == 20_000 and [r.row_number for r in found] == list(range(20_000)) and [r.k for r in found] == [7] * 19_900 + list(range(19_900, 20_000))
    assert most < 10_000
    assert sharding.row_numbered(rows.limit(0), ["k"])[1] == 0
