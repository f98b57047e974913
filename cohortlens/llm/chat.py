"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A JSON record is fingerprinted by hashing the sorted set of its nested field
paths (array places written ``[]``). Each known fingerprint selects a mapping:
a list of rules that say which path gives the text of which role, or which list
holds the turns and what its role and text fields are called. Layouts that
differ only in optional fields share a mapping through several fingerprints.
The canonical turns are then put into a template whose control strings, met
inside a text, are escaped by a backslash that reading takes out again.

Edge cases: null texts and roles are empty; a record of an unknown layout gives
``mapped = false`` and no turns; turns with equal numbers are ordered by role,
then text, and null numbers come first; a null conversation id is a
conversation of its own; a conversation and its texts may be of any length that
fits into a task, as it is one row; repeated rows are turns like others; an
empty table gives an empty result; other columns of the records are passed on,
but for those named layout, fingerprint, mapped, turns, formatted and
loss_spans, which are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    Either ``turns`` (a path to the list, and the names of the role and text
    fields in it) or ``fields``, pairs of a role and the path of its text, in
    order; ``prefix`` pairs come before a list of turns. A missing optional
    field gives no turn.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ("id", "source")

    def layouts(self) -> Iterator[frozenset[str]]:
        """Path sets that this mapping covers."""
        need = {p for _, p in self.fields} - set(self.optional)
        if self.turns:
            top, role, text = self.turns
            need |= {f"{top}[].{role}", f"{top}[].{text}"}
        extra = [*self.optional, *self.ignored]
        for keep in product((False, True), repeat=len(extra)):
            yield frozenset(need | {p for p, k in zip(extra, keep) if k})


MAPPINGS = (
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("sharegpt", turns=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("system and messages", fields=(("system", "system"),), turns=("messages", "role", "content")),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", fields=(("system", "system_prompt"), ("user", "prompt"), ("assistant", "response")), optional=("system_prompt",)),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("nested", fields=(("user", "data.prompt"), ("assistant", "data.response"))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves of a parsed JSON value."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    """Fingerprint -> mapping; an empty list of turns is a layout, too."""
    known: dict[str, Mapping] = {}
    for m in mappings:
        for layout in m.layouts():
            known.setdefault(fingerprint(layout), m)
            if m.turns:
                top = m.turns[0]
                known.setdefault(fingerprint({p for p in layout if not p.startswith(f"{top}[].")} | {f"{top}[]"}), m)
    return known


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _at(record, path: str):
    for k in path.split("."):
        if not isinstance(record, dict) or k not in record:
            return None, False
        record = record[k]
    return record, True


def mapped_turns(record: dict, m: Mapping) -> list[dict[str, str]]:
    out = [{"role": role, "text": _text(v)} for role, p in m.fields for v, there in [_at(record, p)] if there and not (v in ("", None) and p in m.optional)]
    if m.turns:
        top, role, text = m.turns
        names = dict(m.roles)
        out += [{"role": names.get(r := _text(t.get(role)), r), "text": _text(t.get(text))} for t in _at(record, top)[0] or []]
    return out


def canonical_turns(records: DataFrame, json_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Replace the JSON column by ``layout``, ``fingerprint``, ``mapped`` and ``turns`` (role, text)."""
    known = registry(mappings)

    @F.pandas_udf(f"layout string, fingerprint string, mapped boolean, turns {TURNS}")
    def convert(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                record = json.loads(t) if t is not None else None
            except ValueError:
                record = None
            mark = fingerprint(field_paths(record)) if isinstance(record, dict) else None
            m = known.get(mark)
            rows.append((m and m.name, mark, m is not None, mapped_turns(record, m) if m else []))
        return pd.DataFrame(rows, columns=["layout", "fingerprint", "mapped", "turns"])

    rest = [c for c in records.columns if c not in (json_col, "layout", "fingerprint", "mapped", "turns")]
    return records.select(*rest, convert(F.col(json_col)).alias("_c")).select(*rest, "_c.*")


# ---- template

#: Control strings of this and of other common templates; each is escaped behind its first character.
CONTROL = r"/?s>|<?/?SYS>>|\|(?:im_start|im_end|system|user|assistant|endoftext|eot_id)\|>"
BRACKETED = r"/?(?:INST|ROLE)\]"


def escaped(text: Column) -> Column:
    """Put one more backslash behind the first character of control strings (and of what looks like an escaped one)."""
    return F.regexp_replace(F.regexp_replace(text, rf"<(\\*)({CONTROL})", r"<$1\\$2"), rf"\[(\\*)({BRACKETED})", r"[$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<\\(\\*)({CONTROL})", "<$1$2"), rf"\[\\(\\*)({BRACKETED})", "[$1$2")


#: A turn is <s>[ROLE]role[/ROLE]text</s>.
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"


def formatted(turns: Column) -> Column:
    """The conversation as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(CLOSE))), "")


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(text, CLOSE), lambda x: x != "")
    at = lambda x: F.instr(x, MIDDLE)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.substring(x, F.lit(len(OPEN) + 1), at(x) - F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substring(x, at(x) + F.lit(len(MIDDLE)), F.length(x))).alias("text"),
        ),
    )


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, length) in code points, within the formatted text, of each turn's text under the loss mask."""
    frame = len(OPEN) + len(MIDDLE) + len(CLOSE)
    step = lambda acc, t: F.struct(
        (acc["at"] + frame + F.length(escaped(t["role"])) + F.length(escaped(t["text"]))).alias("at"),
        F.when(t["role"] == role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(OPEN) + len(MIDDLE) + F.length(escaped(t["role"]))).alias("start"), F.length(escaped(t["text"])).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, start, step)["spans"]


def turn_lists(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of single turns -> conv_id and turns (role, content) in order."""
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    grouped = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))


def conversation_records(rows: DataFrame, **columns) -> DataFrame:
    """One JSON record per conversation (conv_id, record), all in the ``messages`` layout."""
    return turn_lists(rows, **columns).select("conv_id", F.to_json(F.struct(F.col("turns").alias("messages"))).alias("record"))


def assorted_records(rows: DataFrame, **columns) -> DataFrame:
    """One JSON record per conversation (conv_id, record), as sources of every layout would send them.

    The id picks one of the layouts that can hold the conversation: pairs of a
    user and an assistant turn (a system turn may come first) fit into all, a
    system turn in front into those that name one, anything else into lists of
    turns.
    """
    lists = turn_lists(rows, **columns)
    turns, n = F.col("turns"), F.size("turns")
    roles = F.transform(turns, lambda t: t["role"])
    system = (n > 0) & (F.try_element_at(turns, F.lit(1))["role"] == "system") & (F.try_element_at(turns, F.lit(1))["content"] != "")
    rest = F.when(system, F.slice(turns, 2, n)).otherwise(turns)
    said = lambda k: F.try_element_at(rest, F.lit(k))["content"]
    pair = F.transform(rest, lambda t: t["role"]) == F.array(F.lit("user"), F.lit("assistant"))
    first = F.when(system, F.try_element_at(turns, F.lit(1))["content"])
    plain = ~F.arrays_overlap(roles, F.array(F.lit("human"), F.lit("gpt")))
    names = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shared = F.transform(turns, lambda t: F.struct(names(t["role"]).alias("from"), t["content"].alias("value")))
    pick = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(8))
    layouts = [
        (pair & (pick == 1), F.struct(first.alias("system"), said(1).alias("instruction"), said(2).alias("output"))),
        (pair & (pick == 2), F.struct(first.alias("system_prompt"), said(1).alias("prompt"), said(2).alias("response"))),
        (pair & ~system & (pick == 3), F.struct(said(1).alias("prompt"), said(2).alias("completion"))),
        (pair & ~system & (pick == 4), F.struct(said(1).alias("question"), said(2).alias("answer"))),
        (pair & ~system & (pick == 5), F.struct(F.struct(said(1).alias("prompt"), said(2).alias("response")).alias("data"))),
        (system & (pick >= 6), F.struct(first.alias("system"), rest.alias("messages"))),
        (plain & (pick % 2 == 0), F.struct(shared.alias("conversations"))),
    ]
    record = F.to_json(F.struct(turns.alias("messages")))
    for holds, layout in reversed(layouts):
        record = F.when(holds, F.to_json(layout)).otherwise(record)
    return lists.select("conv_id", record.alias("record"))


def formatted_conversations(records: DataFrame, json_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Records -> their other columns, layout, formatted and loss_spans."""
    turns = canonical_turns(records, json_col, mappings)
    return turns.withColumns({"formatted": formatted(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))}).drop("turns")


def digests(done: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and layout, read back from the output."""
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    read = done.withColumn("_turns", read_back(F.col("formatted"))).withColumns({"_said": said, "_loss": under})
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.encode("_said", "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
