"""Quality rules, lines first: drop failing lines, then reject documents that lose too much text.

Every line with a word is tried on its own: it needs a sentence mark; it must
not be navigation (separators between labels), symbol noise, shouting or a
boilerplate phrase. Lines that fail are removed. A document is rejected if the
removed lines hold more than ``most_lost`` percent of its characters, or if it
fails the base rules: too few words, or too many words in repeated windows.

Everything is a column expression over one row; no shuffle, no Python.

Edge cases: null text has no words and fails the base rules; lines without a
word are kept as they are and count as no loss; a very long text is one row, one
of a single long line is one line; repeated rows are measured alike; an empty
table gives an empty result; ``measured`` replaces columns with the names of
added ones, ``kept_documents`` returns all columns as they came. Windows of
words count as equal by a 64-bit hash within their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE, WORD, whole_row

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Fixed phrases of boilerplate lines in four languages, in lower case.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "is licensed", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "we use cookies",
    "enable javascript", "javascript is disabled", "click here", "read more", "subscribe to", "sign up for", "log in to", "share this", "follow us", "powered by", "skip to content", "back to top", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "weiterlesen", "newsletter abonnieren", "zum inhalt springen", "nach oben",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "lire la suite", "abonnez-vous", "aller au contenu", "haut de page",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies", "leer más", "suscríbete", "saltar al contenido", "volver arriba",
)
#: Characters up to which a line with such a phrase counts as boilerplate.
PHRASE_CHARS = 160
MOST_LOST = 50


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


CAPITALS = "[A-ZÀ-ÖØ-Þ]"
SEPARATORS = "[|›»·•>]"
#: What a line needs for any of the counted rules to be worth evaluating.
SUSPECT = rf"[#*$%&<>|›»·•!]|{CAPITALS}{{4}}"


def line_rules(line: Column) -> dict[str, Column]:
    """Name -> whether the line fails the rule. Meant for lines with a word."""
    words, suspect = _count(line, WORD), line.rlike(SUSPECT)
    capitals = line.rlike(f"{CAPITALS}{{4}}") & (words >= 5) & (2 * _count(line, CAPITALS) > F.length(line))
    return {
        "punctuation": ~line.rlike(r"[.!?…。！？]"),
        "navigation": suspect & (5 * _count(line, rf"(?:^|[\x20\x09-\x0D]){SEPARATORS}+(?![^\x20\x09-\x0D])") >= words),
        "symbols": suspect & (2 * _count(line, SYMBOLS) > words),
        "shouting": suspect & ((2 * _count(line, "!!") > words) | capitals),
        "boilerplate": (F.length(line) <= PHRASE_CHARS) & F.lower(line).rlike("|".join(PHRASES)),
    }


def fails(line: Column) -> Column:
    rules = line_rules(line)
    counted = line.rlike(SUSPECT) & (rules["navigation"] | rules["symbols"] | rules["shouting"])
    return line.rlike(r"[^\x20\x09-\x0D]") & (rules["punctuation"] | rules["boilerplate"] | counted)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(words: Column) -> Column:
    """Words that lie in windows of ``WINDOW`` words found twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        def spread(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"])))
            places = F.array_sort(F.transform(twice, lambda x: x["p"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"))
            return F.aggregate(places, start, step)["n"]

        found = bound(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), spread)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.size(w) - WINDOW + 1), lambda x, i: F.xxhash64(x, *[w[i + k] for k in range(1, WINDOW)]))

    return bound(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(bound(windows(w), covered))).cast("long")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _measures(documents: DataFrame, rest: list[Column], text_col: str, most_lost: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(_lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lost = F.aggregate(_lines(text), F.lit(0), lambda n, x: n + F.when(fails(x), F.length(x)).otherwise(F.lit(0)))
    own = bound(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    first = documents.select(
        *rest,
        own.alias("_own"),
        F.col(text_col).alias("_text"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        bound(full, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        lost.cast("long").alias("lost_chars"),
    )
    n, r, said = F.col("_own.n"), F.col("_own.r"), F.coalesce(F.col("_text"), F.lit(""))
    base = (n < 10) | (100 * r > 20 * n)
    kept = ~base & (100 * F.col("lost_chars") <= most_lost * F.length(said))
    clean = F.when(F.col("lost_chars") == 0, F.col("_text")).otherwise(cleaned(said))
    return first.select("*", n.alias("n_words"), r.alias("n_repeat_words"), base.alias("base_failed"), kept.alias("kept"), clean.alias("cleaned")).drop("_own", "_text")


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "cleaned")


def measured(documents: DataFrame, text_col: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept and cleaned (the text without failing lines)."""
    return _measures(documents, [F.col(f"`{c}`") for c in documents.columns if c not in ADDED], text_col, most_lost)


def cleaned(text: Column) -> Column:
    """The text without the lines that fail."""
    return F.array_join(F.filter(_lines(text), lambda x: ~fails(x)), "\n")


def kept_documents(documents: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", most_lost: int = MOST_LOST) -> DataFrame:
    """The documents that pass, without their failing lines; the columns of ``documents``, a count of characters brought up to date."""
    done = _measures(documents, [whole_row(documents)], text_col, most_lost).where("kept")
    new = {text_col: F.col("cleaned")}
    if chars_col in documents.columns:
        new[chars_col] = F.length("cleaned").cast(documents.schema[chars_col].dataType)
    return done.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in documents.columns])
