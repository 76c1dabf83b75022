"""Keywords of many rules, from a table, found in one pass over the text.

An automaton over all keywords reads each text once, whatever their number; a row per word and
rule, or an expression per word, would read it as often as there are words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.session import written

#: Keywords of a block, in characters; larger tables are searched in several passes.
BLOCK_CHARS = 4_000_000
#: Stands between the values of a record's fields, so that no keyword reaches over two.
BETWEEN = "\x01"


def all_fields() -> Column:
    """The values of all fields of a structured record, kept apart."""
    return F.array_join(F.map_values("fields"), BETWEEN)


def keyword_hits(events: DataFrame, keywords: DataFrame, text: Column | str = "raw", by: tuple[str, ...] = ("source_file", "seq")) -> DataFrame:
    """``(*by, rule_id, keyword)``: one row per event and rule with a keyword in the text, whatever the case.

    ``keywords`` has ``rule_id`` and ``keyword``; of several words of a rule in one text the first in
    the alphabet is named. Words that are NULL or empty match nothing, nor does a NULL text. ``text``
    is a column (G1), or ``all_fields()`` (G4). The driver holds one block of at most ``BLOCK_CHARS``
    characters of keywords at a time; blocks are searched one after the other and rules that
    found words in several are merged.
    """
    words = keywords.select(F.col("rule_id").cast("string").alias("rule_id"), F.lower(F.col("keyword").cast("string")).alias("keyword"))
    words = written(words.where(f"rule_id is not null and keyword <> '' and not contains(keyword, '{BETWEEN}')").distinct(), "keywords")
    size = words.agg(F.sum(F.length("keyword") + F.length("rule_id"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_CHARS
    rows = events.select(*by, F.lower(F.col(text) if isinstance(text, str) else text).alias("_text"))
    kinds = rows.select(*by).schema
    out = kinds.simpleString()[len("struct<"):-1]
    schema = ", ".join(p.replace(":", " ", 1) for p in out.split(",")) + ", rule_id string, keyword string"
    found = None
    for block in range(blocks):
        mine = words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == block) if blocks > 1 else words
        held: dict[str, list[str]] = {}
        for r in mine.collect():
            held.setdefault(r["keyword"], []).append(r["rule_id"])
        part = rows.mapInArrow(_finder(held, list(by)), schema)
        found = part if found is None else found.union(part)
    return found if blocks == 1 else found.groupBy(*by, "rule_id").agg(F.min("keyword").alias("keyword"))


def _finder(held: dict[str, list[str]], by: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, ids in held.items():
            automaton.add_word(word, (word, ids))
        if held:
            automaton.make_automaton()
        for batch in batches if held else ():
            at, rules, words = [], [], []
            for n, text in enumerate(batch.column("_text").to_pylist()):
                if not text:
                    continue
                first: dict[str, str] = {}
                for word, ids in {w: ids for _, (w, ids) in automaton.iter(text)}.items():
                    for i in ids:
                        first[i] = min(first.get(i, word), word)
                at += [n] * len(first)
                rules += first.keys()
                words += first.values()
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at, pa.int64())) for c in by],
                                              pa.array(rules, pa.string()), pa.array(words, pa.string())], names=[*by, "rule_id", "keyword"])

    return run
