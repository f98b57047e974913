"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece that they would form, leftmost first among equals, and merges the best
pair until no pair forms a piece; what is left over falls back to bytes.
A text is first cut where no piece of the vocabulary can reach across (before
each run of word marks), so a word is encoded once and remembered. Every word
that a task meets for the first time is checked against the sentencepiece
library, batch by batch; a difference raises an error.

Edge cases: a null text counts as empty; an empty text has no piece but the
end id; white space, control characters, bytes outside the vocabulary and words
of any length encode like all else, very long texts whole; repeated rows give
repeated results; a null id is passed on; an empty table gives an empty result;
other columns, of whatever name, aren't returned.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words that a worker remembers from task to task; beyond it the memory starts afresh (a bound on space, not on what is encoded).
REMEMBERED = 400_000
#: Up to so many symbols the agenda is a plain list whose minimum is searched; longer ones use a heap.
SHORT = 40

codecs.register_error("one-mark-per-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Pieces:
    """The vocabulary of a model file and the agenda over it."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.vocab_size()
        self.piece = [self.library.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(n) if self.library.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.silent = {i for i in range(n) if self.library.is_control(i)}
        self.unknown = self.library.unk_id()
        plain = [i for i in range(n) if i not in self.byte and i not in self.silent and i != self.unknown]
        self.id = {self.piece[i]: i for i in plain}
        self.text = {i: self.piece[i].replace(MARK, " ") for i in plain}
        levels = {s: k for k, s in enumerate(sorted({self.library.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.piece[i]: levels[self.library.get_score(i)] for i in plain}
        self.end = self.library.eos_id()
        if self.library.normalize("a  ﬁ ") != f"{MARK}a{MARK}{MARK}ﬁ{MARK}":
            raise ValueError("only models with identity normalisation, a leading mark and kept white space are supported")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a mark after other characters, so texts can't be cut before marks")

    def merged(self, word: str) -> list[str]:
        """Symbols that are left when no adjacent pair forms a piece any more."""
        symbols = list(word)
        return self._merged_short(symbols) if len(symbols) <= SHORT else self._merged_long(symbols)

    def _merged_short(self, symbols: list[str]) -> list[str]:
        none, rank = len(self.rank), self.rank
        agenda = [rank.get(x + y, none) for x, y in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
            if i < len(agenda):
                agenda[i] = rank.get(symbols[i] + symbols[i + 1], none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[w], i, w) for i in range(n - 1) if (w := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, word = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != word:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = word, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (w := word + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[w], i, w))
            if (h := before[i]) >= 0 and (w := symbols[h] + word) in rank:
                heapq.heappush(agenda, (rank[w], h, w))
        return [s for s in symbols if s]

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for s in self.merged(word):
            if (i := self.id.get(s)) is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def continued(self, ids: list[int]) -> str:
        """Text of the ids of a word inside a text: a leading mark stays a space."""
        try:
            return "".join([self.text[i] for i in ids])
        except KeyError:  # bytes, unknown or control ids
            return self.decoded(ids, first=False)

    def decoded(self, ids: list[int], first: bool = True) -> str:
        """Text of ids: marks become spaces, byte pieces are put together, with ``first`` a leading mark goes."""
        raw, done = bytearray(), []
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
            elif i == self.unknown:
                raw += " ⁇ ".encode()
            elif i not in self.silent:
                s = self.piece[i].replace(MARK, " ")
                raw += (s[1:] if first and s.startswith(" ") else s).encode()
            else:  # a control id parts the bytes around it
                done.append(raw.decode("utf-8", "one-mark-per-byte"))
                raw.clear()
                continue
            first = False
        return "".join(done) + raw.decode("utf-8", "one-mark-per-byte")


@cache
def pieces(model: str) -> Pieces:
    return Pieces(model)


WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def words_of(text: str) -> list[str]:
    """The normalised text, cut before each run of marks."""
    return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


class Remembered(dict):
    """Word -> (ids joined by spaces, number of ids, text), filled as words are met."""

    def __init__(self, of: Pieces):
        self.of, self.fresh = of, []

    def __missing__(self, word: str) -> tuple[str, int, str]:
        ids = self.of.ids(word)
        self[word] = out = (" ".join(map(str, ids)), len(ids), self.of.continued(ids))
        self.fresh.append((word, ids))
        return out

    def checked(self) -> None:
        """Compare what was met since the last call with the library, ids and the text of ids.

        A word is given to it behind a mark of its own text, which its own
        leading mark replaces.
        """
        of = self.of
        known = of.library.encode([w[1:] for w, _ in self.fresh if w[0] == MARK and len(w) > 1])
        for (word, ids), theirs in zip([x for x in self.fresh if x[0][0] == MARK and len(x[0]) > 1], known):
            if ids != theirs:
                raise RuntimeError(f"agenda and library differ on {word!r}: {ids} and {theirs}")
        if of.library.decode([i for _, ids in self.fresh for i in ids]) != "".join([self[w][2] for w, _ in self.fresh])[1:]:
            raise RuntimeError("decoded texts of agenda and library differ")
        self.fresh = []


@cache
def remembered(model: str) -> Remembered:
    return Remembered(pieces(model))


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with ``texts`` also ``ids`` and ``decoded``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = remembered(model)
        end = str(memory.of.end)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                got = [memory[w] for w in words_of(text)]
                joined = " ".join([x[0] for x in got] + [end])
                decoded = "".join([x[2] for x in got])[1:]
                row = [sum([x[1] for x in got]) + 1, sha256(joined.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()]
                rows.append(row + ([[int(i) for i in joined.split(" ")], decoded] if texts else []))
                if len(memory) > REMEMBERED:
                    memory.checked()
                    memory.clear()
            memory.checked()
            yield pd.DataFrame(rows, columns=names).assign(doc_id=batch["doc_id"].to_numpy())[["doc_id", *names]]

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, schema)


def decoded_texts(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of a column of ids; a null list gives a null text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        of = pieces(model)
        return ids.map(lambda x: None if x is None else of.decoded([int(i) for i in x]))

    return rows.withColumn("decoded", decode(F.col(ids_col)))
