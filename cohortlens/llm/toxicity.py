"""Toxicity scores behind a noisy channel.

1. A character trigram model over 29 symbols (a to z, a boundary, other
   letters, digits and signs) is counted over every document.
2. Words that look disguised - digits or signs among letters, runs of one
   letter, letters set apart - are read as a lattice of what each character may
   stand for; Viterbi picks the likeliest reading under the language model and
   the costs of the channel. A plain reading costs nothing, so odd but genuine
   words stay as they are.
3. Words and their readings are scored by log odds of their character n-grams,
   learned from labelled rows of the training folds; a logistic model of a
   document's worst words gives the score.

Only a bounded sample of labelled rows is used to fit (``per_class`` rows of
each class, by a seeded hash of the id); every document is counted and scored.

Edge cases: null and empty texts get the score of a text without any suspicious
word; a null id is held out of training; labels that are null or repeated are
left out or counted as they come; without labels of both classes every score is
the share of toxic labels (0.0 without any); an empty table gives an empty result;
very long texts are counted and scored whole; repeated rows score alike; other
columns, of whatever name, are no inputs and aren't returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import portions, small, stored

SYMBOLS = 29
OTHER, SIGN = 27, 28
#: What characters may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
SEPARATORS = ".-_~ "
EDGES = ".,;:!?\"'()[]{}«»„“”…|"
TRIPLE = re.compile(r"(.)\1\1")
#: Log probabilities of the channel: a letter replaced, repeated, a separator put in.
REPLACED, REPEATED, PARTED = -2.0, -1.5, -1.5
#: Labelled rows of each class to fit on, at most.
PER_CLASS = 10_000
#: Toxic documents that have an n-gram which the model learns: at least so many, and at least one in so many.
LEAST_DOCS = 3
ONE_IN = 2000
#: Documents that an n-gram's share of toxic ones is drawn towards the overall share with.
PRIOR = 8
REMEMBERED = 300_000


def _byte_symbols() -> np.ndarray:
    """Symbol of each byte of a UTF-8 text; continuation bytes (128 to 191) are taken out before."""
    table = np.full(256, OTHER, np.int64)
    table[:128] = SIGN
    for i in range(26):
        table[65 + i] = table[97 + i] = i + 1
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[[ord(c) for c in ".,;:!?\"()"]] = 0
    return table


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = _byte_symbols()
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in portions(batches):
        raw = np.frombuffer("\n\n".join(["", *batch["text"], ""]).encode(), np.uint8)
        s = table[raw[(raw < 128) | (raw > 191)]]
        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    found = np.flatnonzero(total)
    yield pd.DataFrame({"trigram": found.astype(np.int32), "n": total[found]})


def trigram_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """trigram (an index below 29**3) and n over all documents."""
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(_trigrams, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def log_probabilities(trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) by [a, b, c], backing off to P(c | b)."""
    n = np.zeros(SYMBOLS**3)
    n[trigrams] = counts
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = n.sum(0) + 0.1
    pair /= pair.sum(1, keepdims=True)
    return np.log((n + 2.0 * pair[None]) / (n.sum(2, keepdims=True) + 2.0))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c in SEPARATORS else OTHER if c.isalpha() else SIGN


def _readings(c: str, run: int, inner: bool) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with log probabilities."""
    plain = [(c * run, 0.0)]
    if c.isalpha():
        return plain + ([(c, REPEATED), (c * 2, REPEATED)] if run > 2 else [])
    if c in LEET:
        plain += [(x * min(run, 2), REPLACED) for x in LEET[c]]
        plain += [(x, REPLACED + REPEATED) for x in LEET[c]] if run > 1 else []
    if inner and (c in SEPARATORS or c == "*"):
        plain.append(("", PARTED))
    return plain


def decoded(token: str, logp: np.ndarray) -> str:
    """The likeliest reading of a token in lower case, by Viterbi over the last two symbols."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    groups = [(c, sum(1 for _ in g)) for c, g in groupby(token)]
    for k, (c, run) in enumerate(groups):
        reached: dict[tuple[int, int], tuple[float, tuple]] = {}
        for out, cost in _readings(c, run, 0 < k < len(groups) - 1):
            symbols = [_symbol(x) for x in out]
            for (a, b), (p, path) in states.items():
                q = p + cost
                for s in symbols:
                    q += logp[a, b, s]
                    a, b = b, s
                if (a, b) not in reached or reached[a, b][0] < q:
                    reached[a, b] = (q, (path, out))
        states = reached
    _, path = max((p + logp[a, b, 0], path) for (a, b), (p, path) in states.items())
    parts = []
    while path:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))


def disguised(token: str) -> bool:
    letters = any("a" <= c <= "z" for c in token)
    return letters and (any(c in LEET or c in SEPARATORS for c in token) or any(a == b == c for a, b, c in zip(token, token[1:], token[2:])))


def restored(token: str, logp: np.ndarray) -> list[str]:
    """Words to score for a token: itself and, if it looks disguised, its reading."""
    word = token.strip(EDGES)
    if word.isalpha() and not TRIPLE.search(word) and not any(c in token for c in "!$|"):
        return [word]
    words = [word]
    if disguised(word) or any(c in "!$|" for c in token) and disguised(token.rstrip(".,;:?\"')")):
        for t in {word, token.rstrip(".,;:?\"')")}:
            if t:
                words += decoded(t, logp).translate(_TO_SPACE).split()
    return list(dict.fromkeys(w for w in words if w))


_TO_SPACE = str.maketrans({c: " " for c in SEPARATORS})


def set_apart(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters, joined by spaces."""
    return [" ".join(g) for one, run in groupby(tokens, lambda t: len(t) == 1) if one and len(g := list(run)) > 2]


def ngrams(word: str) -> tuple[str, ...]:
    """The whole word, its beginnings and its inner n-grams."""
    w = f"^{word}$"
    n = len(w)
    return (w, *[w[:k] for k in range(5, min(n, 9)) if k != 6], *[w[i : i + 6] for i in range(n - 5) if n > 6])


def _all_words(text: str, of: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, ...]]:
    """What ``of`` holds for each different token of a text, and for letters set apart."""
    tokens = text.lower().split()
    yield from (of[t] for t in set(tokens))
    if sum([len(t) == 1 for t in tokens]) > 2:
        yield from (of[t] for t in set_apart(tokens))


class _Remembered(dict):
    """What ``make`` gives for each token, kept up to a bound."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, token):
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = out = self.make(token)
        return out


def _token_grams(logp: np.ndarray) -> _Remembered:
    return _Remembered(lambda token: tuple({g for w in restored(token, logp) for g in ngrams(w)}))


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(5))


@dataclass
class Model:
    """Log odds of n-grams and the logistic model over a document's worst words."""

    logp: np.ndarray
    odds: dict[str, float]
    weights: np.ndarray | None = None
    base: float = 0.0

    def token_odds(self) -> _Remembered:
        """Odds of the worst n-gram of a token; kept with the model, so a worker remembers them from task to task."""
        if "memory" not in self.__dict__:
            self.memory = _Remembered(self.worst)
        return self.memory

    def worst(self, token: str) -> float:
        found, most = self.odds.get, 0.0
        for w in restored(token, self.logp):
            for g in ngrams(w):
                if (x := found(g, 0.0)) > most:
                    most = x
        return most

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memory"}

    def traits(self, text: str, odds: _Remembered) -> list[float]:
        found = sorted((x for x in _all_words(text, odds) if x > 0), reverse=True)
        return [1.0, found[0] if found else 0.0, math.log1p(sum(found[1:4])), math.log1p(sum(x for x in found if x > 2))]

    def score(self, traits: list[float]) -> float:
        if self.weights is None:
            return self.base
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights @ np.array(traits))))))


def labelled_sample(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 5) -> tuple[DataFrame, float]:
    """Texts and labels of at most about ``per_class`` training rows of each class, and the share of toxic ones among all training labels."""
    train = labels.where((fold(F.col(id_col)) != 0) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("y"))
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    rate = {y: min(1.0, per_class / max(1, n.get(y, 0))) for y in (0, 1)}
    place = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000)) / 1_000_000
    chosen = stored(train.where(place < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])), "toxic-labels")
    texts = documents.join(small(chosen, 16), documents[id_col] == chosen["_id"]).select("_id", "y", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(texts, "toxic-sample"), n.get(1, 0) / max(1, sum(n.values()))


def fitted(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = documents.sparkSession
    counts = trigram_counts(documents, text_col).toPandas()  # at most 29**3 rows
    logp = log_probabilities(counts["trigram"].to_numpy(), counts["n"].to_numpy())
    sample, share = labelled_sample(documents, labels, per_class, id_col, text_col, label_col)
    model = Model(logp, {}, base=share)
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return model
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(logp)

    def counted(wanted):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of, total = _token_grams(shared.value), Counter()
            keep = wanted and wanted.value
            for batch in batches:
                for text in batch["text"]:
                    grams = set().union(*_all_words(text, of))
                    total.update(grams & keep if keep else grams)
            if total:
                yield pd.DataFrame({"gram": list(total.keys()), "n": list(total.values())})

        return run

    spread = sample.repartition(parts)
    toxic = spread.where("y = 1").select("text").mapInPandas(counted(None), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(LEAST_DOCS, n[1] // ONE_IN)
    often = toxic.where(F.col("n") >= least).toPandas()  # of the bounded sample
    wanted = spark.sparkContext.broadcast(frozenset(often["gram"]))
    clean = spread.where("y = 0").select("text").mapInPandas(counted(wanted), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("m")).toPandas()
    both = often.merge(clean, on="gram", how="left").fillna({"m": 0})
    rate = n[1] / (n[0] + n[1])
    share_of = (both["n"] + PRIOR * rate) / (both["n"] + both["m"] + PRIOR)
    odds = np.log(share_of / (1 - share_of)) - math.log(rate / (1 - rate))
    model.odds = {g: float(o) for g, o in zip(both["gram"], odds) if o > 0.5}

    sent = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        odds = m.token_odds()
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [m.traits(t, odds) for t in batch["text"]]})

    rows = spread.select("y", "text").mapInPandas(measured, "y int, x array<double>").toPandas()  # the bounded sample
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy(float)
    model.weights = _logistic(x, y)
    model.weights[0] += math.log(share / (1 - share)) - math.log(n[1] / n[0])  # classes were sampled at different rates
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic model."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        odds = m.token_odds()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": [m.score(m.traits(t, odds)) for t in batch["text"]]})

    kind = documents.schema[id_col].dataType.simpleString()
    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(True))
    rows = documents.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fit on the training folds of ``labels`` and score all ``documents``."""
    return scored(documents, fitted(documents, labels, per_class))
