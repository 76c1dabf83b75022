"""Benchmark decontamination with an FM-index per training shard (operator 6).

A task indexes its documents shard by shard: words that no test phrase uses are one and the
same cut, and what lies between cuts is sorted into a suffix array whose Burrows-Wheeler
transform sits in a wavelet matrix. All test phrases are searched backwards together; the
rows they end in are followed to the next sampled suffix position, which gives every
occurrence. Occurrences merge into removal spans. The documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exactly, written

#: Keeps letters, digits and non-ASCII bytes (A-Z lower-cased); all else ends a word.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD_BYTES = re.compile(rb"[^\x20]+")
BLOCK_BYTES = 8_000_000
SHARD_BYTES = 8_000_000


class FMIndex:
    """Index of a sequence of symbols >= 1 with cuts (0), which match nothing."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        n = len(seq)
        self.n = n
        self.seq = seq
        cuts = int((seq == 0).sum())
        # every cut is a symbol of its own, so suffixes differ at the next cut at the latest
        rank = np.where(seq == 0, np.cumsum(seq == 0) - 1, seq.astype(np.int64) + cuts)
        order, step = np.argsort(rank, kind="stable"), 1
        fresh = np.append(True, rank[order][1:] != rank[order][:-1])
        while not fresh.all():
            place = np.empty(n, np.int64)
            place[order] = np.cumsum(fresh) - 1
            after = np.zeros(n, np.int64)
            after[:-step] = place[step:] + 1
            key = place * (n + 1) + after
            order = np.argsort(key, kind="stable")
            fresh = np.append(True, key[order][1:] != key[order][:-1])
            step *= 2
        self.bwt = seq[order - 1]  # the last symbol is a cut, so row 0's wrap is one too
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))])
        marked = (order % sample == 0) | (self.bwt == 0)
        self.marked, self.position = marked, np.where(marked, order, -1)
        self.levels, left = [], self.bwt.astype(np.int64)
        for bit in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            ones = (left >> bit) & 1
            upto = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((bit, upto, n - int(upto[-1])))
            left = np.concatenate([left[ones == 0], left[ones == 1]])

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often a symbol occurs in the transform before a row."""
        low, high = np.zeros_like(row), row
        for bit, upto, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + upto[low], low - upto[low])
            high = np.where(one, zeros + upto[high], high - upto[high])
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase (rows of symbols, padded at the end)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(phrases.shape[1]):
            live = live[(lengths[live] > back) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - back]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled row, plus its position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[rows])
        while len(live):
            symbol = self.bwt[rows[live]].astype(np.int64)
            rows[live] = self.before[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.marked[rows[live]]]
        return self.position[rows] + steps


class Phrases:
    """Windows of test items as rows of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in split_words(text)]
            for i in range(max(1, len(ids) - width + 1)) if ids else ():
                owners.setdefault(tuple(ids[i:i + width]), set()).update(() if item is None else (item,))
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.rows = np.zeros((len(owners), width), np.int64)
        for i, w in enumerate(owners):
            self.rows[i, :len(w)] = w
        self.shortest = int(self.lengths.min()) if len(owners) else 0


def split_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def occurrences(texts: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, phrase) of every occurrence in the documents of one shard."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    get = phrases.words.get
    ids = np.fromiter((i for t in texts for i in map(get, t, repeat(0))), np.int32, total)
    nothing = np.zeros(0, np.int64)
    if not total or not len(phrases.rows):
        return nothing, nothing, nothing
    # runs of words the phrases know, within one document, long enough for the shortest phrase
    ends = np.cumsum(sizes)
    edge = np.zeros(total + 1, bool)
    edge[ends] = True
    known = ids > 0
    start = np.flatnonzero(known & (np.append(True, ~known[:-1]) | edge[:-1]))
    stop = np.flatnonzero(known & (np.append(~known[1:], True) | edge[1:])) + 1
    fits = stop - start >= phrases.shortest
    start, size = start[fits], (stop - start)[fits]
    if not len(start):
        return nothing, nothing, nothing
    # the runs side by side, a cut after each
    at = np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    origin = np.repeat(start, size + 1) + at
    cut = at == np.repeat(size, size + 1)
    seq = np.where(cut, 0, ids[np.minimum(origin, total - 1)])
    index = FMIndex(seq, len(phrases.words))
    low, high = index.search(phrases.rows, phrases.lengths)
    count = np.maximum(0, high - low)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    word = origin[index.locate(rows)]
    doc = np.searchsorted(ends, word, side="right")
    return doc, word - (ends - sizes)[doc], phrase


def marked(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text",
           item_col: str = "item_id", prefix: str = "__") -> DataFrame:
    """docs with words (number of words), spans (merged word spans, end excluded) and items (item ids
    found), each after ``prefix``.

    An item's windows are its runs of ``width`` words, or all its words if it has fewer.
    Test items are taken in blocks of bounded size; every block is searched in all rows, and
    spans of several blocks are merged, so that the size of the benchmark changes no result.
    Null and empty texts have no words and no hits; items without words match nothing;
    items without id mark spans but are not listed; repeated items and rows change nothing;
    an empty benchmark leaves all documents clean. Other columns stay as they are, but for
    those of the three names: ``without_spans`` finds a free prefix.
    """
    words_, spans_, items_, found_ = (f"{prefix}{c}" for c in ("words", "spans", "items", "found"))
    items = benchmark.select(exactly(item_col).cast("string").alias("item"), exactly("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    out = docs.withColumns({words_: F.lit(0).cast("long"), spans_: F.array().cast(SPANS), items_: F.array().cast("array<string>")})
    # copies of one text are dealt by their ids, so a block stays near its share
    where = F.pmod(F.xxhash64("text", "item"), F.lit(blocks))
    for block in range(blocks):
        # at most about BLOCK_BYTES of text
        held = [(r.item, r.text) for r in (items.where(where == block) if blocks > 1 else items).collect()]
        phrases = Phrases(held, width)
        out = out.withColumn(found_, _finder(phrases)(exactly(text_col)))
        out = out.withColumns({words_: F.col(found_)["words"], spans_: F.concat(spans_, F.col(found_)["spans"]) if block else F.col(found_)["spans"],
                               items_: F.array_union(items_, F.col(found_)["items"])}).drop(found_)
        if blocks > 1:
            out = written(out, "decontaminated")
    return out if blocks == 1 else out.withColumn(spans_, _disjoint(F.col(spans_)))


SPANS = "array<struct<a:bigint,b:bigint>>"


def _disjoint(spans: Column) -> Column:
    """Overlapping or touching spans as one, in order."""
    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when(last.isNotNull() & (s["a"] <= last["b"]), longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def _finder(phrases: Phrases):
    # evaluated once: filters that use its result may not repeat it
    @F.pandas_udf("words long, spans array<struct<a:bigint,b:bigint>>, items array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, spans, items, begin = [], [], [], 0
            raw = list(batch)
            while begin < len(raw):
                end, taken = begin, 0
                while end < len(raw) and (end == begin or taken < SHARD_BYTES):
                    taken += len(raw[end] or "")
                    end += 1
                texts = [split_words(t) for t in raw[begin:end]]
                found: dict[int, list] = {}
                for d, w, p in zip(*(x.tolist() for x in occurrences(texts, phrases))):
                    found.setdefault(d, []).append((w, w + int(phrases.lengths[p]), p))
                for d, t in enumerate(texts):
                    words.append(len(t))
                    spans.append(merged(found.get(d, ())))
                    items.append(sorted({i for *_, p in found.get(d, ()) for i in phrases.owners[p]}))
                begin = end
            yield pd.DataFrame({"words": words, "spans": spans, "items": items})

    return find.asNondeterministic()


def merged(spans) -> list[dict]:
    """Overlapping or touching (a, b, ...) as disjoint spans in order."""
    out: list[dict] = []
    for a, b, *_ in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row (see ``marked``)."""
    found = marked(docs.select(exactly(id_col).cast("long").alias("doc_id"), exactly("text").cast("string").alias("text")), benchmark, width)
    covered = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", F.col("__words").alias("n_words"), covered.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
                        (F.size("__spans") > 0).alias("contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with every removal span cut out of ``text``; documents whose words are all cut go.

    Blanks around a span stay; ``n_chars``, where there is one, is counted anew. Null and empty
    texts, and all of an empty benchmark's documents, stay as they are; repeated rows are cut alike;
    an empty table gives no rows. Other columns keep their values, whatever their names.
    """
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    words_, spans_ = F.col(f"{prefix}words"), F.col(f"{prefix}spans")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if t is not None and len(s):
                raw = t.encode("utf-8", "surrogatepass")
                at = [m.span() for m in WORD_BYTES.finditer(raw.translate(TO_WORDS))]
                keep, last = [], 0
                for a, b in ((x["a"], x["b"]) for x in s):
                    keep.append(raw[last:at[a][0]])
                    last = at[b - 1][1]
                t = b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")
            out.append(t)
        return pd.Series(out, dtype=object)

    found = marked(docs, benchmark, width, prefix=prefix)
    only = F.get(spans_, F.lit(0))
    whole = (F.size(spans_) == 1) & (only["a"] == 0) & (only["b"] == words_)
    dirty = F.size(spans_) > 0
    # only rows with a span go through the cutter a second time
    cleaned = found.where(~whole).withColumn("text", F.when(dirty, cut(F.when(dirty, F.col("text")), spans_)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(dirty, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*[exactly(c) for c in docs.columns])
