"""Chat formatting by schema fingerprints (operator 7).

A record's nested field paths, restricted to those any layout knows, are hashed; the hash
selects a declarative layout, and the layout turns the record into canonical turns. Turns
are rendered with control marks that escaped text cannot contain, and the loss mask holds
the character spans of the assistant's texts in the rendered string.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exactly

START, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Escape letters: no mark survives in a text, as each begins with "<".
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))


@dataclass(frozen=True)
class Layout:
    """How one kind of record holds its turns.

    ``turns``: (role, path) in order, for records with a field per turn; several paths of
    one role in a row are joined by an empty line. ``items``: path of a list of turns with
    its ``role`` and ``text`` fields; without ``items`` the record is itself one turn with these
    fields. ``optional`` paths may be missing.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.items:
            return {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}
        return {self.role, self.text} if self.role else {p for _, p in self.turns}


LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content"),
    Layout("dialogue", items="conversations", role="from", text="value"),
    Layout("prompt", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("instruction", turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Layout("question", turns=(("user", "data.question"), ("assistant", "data.answer"))),
)
#: A row of a table of turns, whose roles stand as they are. Not among the others: its fields may be extra ones of a larger record.
TURN = Layout("turn", role="role", text="text")
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def catalog(layouts=LAYOUTS) -> tuple[dict[str, Layout], set[str]]:
    """Fingerprint -> layout, with and without optional paths; and all known paths."""
    found: dict[str, Layout] = {}
    for x in layouts:
        for n in range(len(x.optional) + 1):
            for gone in combinations(x.optional, n):
                found.setdefault(fingerprint(x.paths() - set(gone)), x)
    return found, set().union(*(x.paths() for x in layouts))


def field_paths(record) -> set[str]:
    """Paths of all leaves; members of lists share one path."""
    out, todo = set(), [("", record)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(f"{path}[]", v) for v in value]
        else:
            out.add(path)
    return out


def _at(record, path: str):
    for step in path.split("."):
        record = record.get(step) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    if layout.items:
        pairs = [(_text(x.get(layout.role)), _text(x.get(layout.text))) for x in _at(record, layout.items) if isinstance(x, dict)]
        return [(ROLES.get(r, r), t) for r, t in pairs]
    if layout.role:
        return [(_text(_at(record, layout.role)), _text(_at(record, layout.text)))]
    out: list[tuple[str, str]] = []
    for role, path in layout.turns:
        if (value := _at(record, path)) is None:
            continue
        if out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{_text(value)}") if _text(value) else out[-1]
        else:
            out.append((role, _text(value)))
    return out


def turn_records(rows: DataFrame) -> DataFrame:
    """A table of turns -> (conv_id, turn, record): a JSON record of role and text per row."""
    record = F.to_json(F.struct(exactly("role").alias(TURN.role), exactly("text").alias(TURN.text)), {"ignoreNullFields": "false"})
    return rows.select("conv_id", exactly("turn").cast("long").alias("turn"), record.alias("record"))


def canonical(records: DataFrame, id_col: str = "conv_id", json_col: str = "record", layouts=LAYOUTS,
              turn_col: str | None = None) -> DataFrame:
    """JSON records of any known layout -> rows (conv_id, turn, role, text, layout).

    Turns are numbered from 0 in their record; a record that is itself one turn has the number
    in ``turn_col``. A record that is null, not JSON, or of no known layout gives one row with null turn,
    role, text and layout, so that nothing goes unseen. Repeated records and equal or null ids give
    their own rows each; other columns are ignored; an empty table gives no rows.
    """
    known, paths = catalog(layouts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            places = batch["turn"].astype("Int64")
            for key, place, text in zip(batch["conv_id"], places, batch["record"]):
                try:
                    record = json.loads(text)
                    layout = known.get(fingerprint(field_paths(record) & paths))
                except (TypeError, ValueError, RecursionError):
                    layout = None
                turns = turns_of(record, layout) if layout else None
                whole = layout and not layout.items and not layout.turns
                rows += ([(key, place if whole else i, r, t, layout.name) for i, (r, t) in enumerate(turns)] if turns
                         else [(key, None, None, None, None)])
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "layout"]).astype({"conv_id": "Int64", "turn": "Int64"})

    place = (F.lit(None) if turn_col is None else exactly(turn_col)).cast("long").alias("turn")
    return records.select(exactly(id_col).cast("long").alias("conv_id"), place, exactly(json_col).cast("string").alias("record")).mapInPandas(
        run, "conv_id long, turn long, role string, text string, layout string")


def escaped(c: Column) -> Column:
    for mark, code in ESCAPES:
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    """Escape codes are read in pairs from the left, so a doubled backslash is a cut."""
    parts = F.split(c, F.lit("\\\\\\\\"), -1)  # the regular expression of two backslashes
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(plain, "\\")


def formatted(rows: DataFrame, block: int = 64) -> DataFrame:
    """Turn rows -> conv_id, formatted, loss (spans of code points under the loss mask, 0-based, end excluded).

    Turns are in order of turn, then role, then text; null turns come first, null roles and
    texts are empty. Pieces of ``block`` turn numbers are rendered on their own and joined
    after, so a very long conversation is rendered by many tasks. Repeated rows are turns
    of their own; null is a conversation like any other id; extra columns are ignored.
    """
    role, text = F.coalesce(exactly("role"), F.lit("")), F.coalesce(exactly("text"), F.lit(""))
    turn = F.struct(exactly("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    pieces = rows.select("conv_id", F.floor(exactly("turn") / block).alias("at"), turn.alias("t")).groupBy("conv_id", "at").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = pieces.select("conv_id", "at", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escaped(t["role"]), F.lit(BODY)).alias("head"), escaped(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("mask"))).alias("turns"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["head"])
        stop = begin + F.length(t["body"])
        return F.struct(
            (stop + len(END)).cast("long").alias("at"),
            F.when(t["mask"], F.concat(acc["spans"], F.array(F.struct(begin.cast("long").alias("a"), stop.cast("long").alias("b")))))
            .otherwise(acc["spans"]).alias("spans"))

    pieces = pieces.select("conv_id", "at", rendered.alias("piece"), F.aggregate("turns", zero, step)["spans"].alias("spans"))
    # where a piece begins in its conversation: a running sum of piece lengths
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("base")).alias("a"), (s["b"] + F.col("base")).alias("b")))
    joined = pieces.select("conv_id", F.struct("base", "piece", moved.alias("spans")).alias("p")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("p")).alias("p"))
    return joined.select("conv_id", F.array_join("p.piece", "").alias("formatted"), F.flatten("p.spans").alias("loss"))


def read_back(done: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role and text) and loss_texts, parsed from the formatted string."""
    cut = F.split("formatted", r"<\|turn\|>", -1)
    chunks = F.slice(cut, F.lit(2), F.size(cut) - 1)
    turns = F.transform(chunks, lambda c: F.struct(
        unescaped(F.substring_index(c, BODY, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(c, BODY, -1), END, 1)).alias("text")))
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))))
    return done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))
