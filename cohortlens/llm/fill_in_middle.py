"""Fill-in-middle: texts are cut at two token boundaries and written as prefix, suffix and middle behind marks.

Each text becomes a UTF-32 array of code points. Where the class of neighbours
changes from word to white space a token ends, so ``flatnonzero`` over compared
neighbours gives all boundaries at once; the ranks of the two cuts pick two of
them, and the pieces are slices of the array, encoded again. Cuts and forms come
from a SHA-256 of seed and id, so a document is always cut alike, wherever it
lies and whatever else is in the table. Batches of at most 64 MB
(``spark.sql.execution.arrow.maxBytesPerBatch``) go through Python; no row needs
another one, so nothing is shuffled.

Edge cases: null text counts as empty; an empty text has no tokens and stays
plain; a text of white space only is one token; a text that holds one of the
marks stays plain, so every output can be taken apart again; a null id is an
empty id; rows of equal ids and texts give equal rows; a very long text is one
array of four bytes a character; an empty table gives an empty result; other
columns of the input, whatever their names, aren't returned.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    """The text as a UTF-32 array."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def boundaries(points: np.ndarray) -> np.ndarray:
    """0 and the end of every token: white space with the word behind it, or the white space that ends the text."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    inner = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate(([0], inner, [len(points)] if len(points) else [])).astype(np.int64)


def piece(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def draws(seed: int, key: Column, n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight hex digits of the SHA-256 of ``seed:key``, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, cut_percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output of every row."""
    before_prefix, before_suffix, before_middle = marks

    @F.pandas_udf(CUT)
    def cut(text: pd.Series, form: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for t, kind, a, b in zip(text, form, one, two):
            points = code_points(t)
            at = boundaries(points)
            n = len(at) - 1
            if kind == "plain":
                rows.append((n, kind, None, None, t))
                continue
            first, second = at[min(a % (n + 1), b % (n + 1))], at[max(a % (n + 1), b % (n + 1))]
            prefix, middle, suffix = piece(points[:first]), piece(points[first:second]), piece(points[second:])
            said = before_prefix + prefix + before_suffix + suffix if kind == "psm" else before_suffix + suffix + before_prefix + prefix
            rows.append((n, kind, int(first), int(second - first), said + before_middle + middle))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    marked = reduce(lambda x, y: x | y, [F.contains("_text", F.lit(m)) for m in marks])
    plain = (F.col("_text") == "") | marked | (h3 % 100 >= cut_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    return rows.select("doc_id", cut("_text", form, h1, h2).alias("_cut")).select("doc_id", "_cut.*")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from: cut at its marks, which the text doesn't hold, and put in order."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
