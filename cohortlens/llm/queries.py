"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import chat, exact_dedup, fill_in_middle, html_main, mixing, ngram_join, quality, repeated_spans, sentencepiece_bpe, sharding, toxicity, warc, whitening
from cohortlens.llm.common import dealt_evenly, table


def model_path() -> str:
    """Where the public 32k vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(dealt_evenly(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(dealt_evenly(table(spark, sf_dir, "documents")), n=3, percent=90)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    records = chat.assorted_records(rows.select("conv_id", "turn", "role", "text").unionByName(more))
    return chat.digests(chat.formatted_conversations(records))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encoded(dealt_evenly(table(spark, sf_dir, "documents")), model_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.measured(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(dealt_evenly(table(spark, sf_dir, "pages")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(dealt_evenly(table(spark, sf_dir, "documents")))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    made = digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *made)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_spans.kept_words(dealt_evenly(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def registered() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


# ---- SQL of the queries that SQL can express

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CONTROL, _BRACKETED = (x.replace("'", "''") for x in (chat.CONTROL, chat.BRACKETED))
_ESCAPED = rf"regexp_replace(regexp_replace({{0}}, '<(\\*)({_CONTROL})', '<\1\\\2', 'g'), '\[(\\*)({_BRACKETED})', '[\1\\\2', 'g')"
_FRAME = len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)
_PHRASES = "|".join(quality.PHRASES).replace("'", "''")

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
        g AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN g USING (payload_digest)""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_ngram_jaccard": rf"""
        WITH RECURSIVE low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT doc_id, {_WORDS} AS ws FROM low),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
              ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM s),
        e AS (SELECT doc_id, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT y, root FROM r JOIN l ON r.doc_id = x),
        k AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
        SELECT n.doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM n JOIN c USING (doc_id) LEFT JOIN k ON x = n.doc_id""",
    "op7_chat_format": rf"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
              coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
              sum({_FRAME} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS chars,
              list(role ORDER BY turn, role, text) AS roles, first(text ORDER BY turn, role, text) AS top FROM rows GROUP BY 1),
        k AS (SELECT *, roles[1] = 'system' AND top <> '' AS sys, (conv_id % 8 + 8) % 8 AS pick, CASE WHEN roles[1] = 'system' AND top <> '' THEN roles[2:] ELSE roles END = ['user', 'assistant'] AS pair FROM c)
        SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars,
               CASE WHEN pair AND pick = 1 THEN 'instruction' WHEN pair AND pick = 2 THEN 'prompt and response' WHEN pair AND NOT sys AND pick = 3 THEN 'prompt' WHEN pair AND NOT sys AND pick = 4 THEN 'question'
               WHEN pair AND NOT sys AND pick = 5 THEN 'nested' WHEN sys AND pick >= 6 THEN 'system and messages' WHEN pick % 2 = 0 AND NOT list_has_any(roles, ['human', 'gpt']) THEN 'sharegpt' ELSE 'messages' END AS layout
        FROM k""",
    "op9_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)),
        o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM o, range(5) q(k) WHERE n > 1 GROUP BY 1),
        x AS (SELECT doc_id, line, length(line) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: regexp_full_match(w, '[|›»·•>]+'))) AS bars,
              len(regexp_extract_all(line, '[#*$%&|<>]')) AS signs, len(regexp_extract_all(line, '!!')) AS calls, len(regexp_extract_all(line, '[A-ZÀ-ÖØ-Þ]')) AS caps FROM (SELECT doc_id, unnest(ls) AS line FROM t)),
        f AS (SELECT doc_id, chars, words > 0 AND (NOT regexp_matches(line, '[.!?…。！？]') OR chars <= {quality.PHRASE_CHARS} AND regexp_matches(lower(line), '{_PHRASES}')
              OR regexp_matches(line, '[#*$%&<>|›»·•!]|[A-ZÀ-ÖØ-Þ]{{4}}') AND (5 * bars >= words OR 2 * signs > words OR 2 * calls > words OR regexp_matches(line, '[A-ZÀ-ÖØ-Þ]{{4}}') AND words >= 5 AND 2 * caps > chars)) AS bad FROM x),
        z AS (SELECT doc_id, coalesce(sum(chars) FILTER (bad), 0)::BIGINT AS lost_chars FROM f GROUP BY 1),
        m AS (SELECT doc_id, text, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
              len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines FROM t),
        b AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed, lost_chars FROM m LEFT JOIN r USING (doc_id) JOIN z USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {quality.MOST_LOST} * length(text) AS kept, lost_chars FROM b""",
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
        h AS (SELECT *, len(ts) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(ts[:a], '') AS prefix, array_to_string(ts[a + 1 : b], '') AS middle, array_to_string(ts[b + 1 :], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op13_repeated_spans": rf"""
        WITH t AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM t)),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS place FROM g),
        r AS (SELECT DISTINCT doc_id, i + k AS pos FROM f, range(20) q(k) WHERE place > 1),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n_kept FROM w ANTI JOIN r USING (doc_id, pos) GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)""",
}
