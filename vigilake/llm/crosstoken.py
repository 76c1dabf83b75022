"""Cross-tokenizer alignment with external spill counting (operator 11).

Two tokenizers cut the same bytes. Where both cut, the last token of each side is linked; how
often a pair of ids is linked in the whole corpus says which link of an id is the usual one.
Tokenizing happens once: a task writes, per chunk of texts, the rows of its documents and, per
radix of the second tokenizer's id, a run of pair-document records, sorted by pair and packed
with zstd. Runs are merged in passes of bounded width by a k-way heap; the last pass walks the
pairs by second id, so the highest count of an id is known where its pairs end. Counts then
stream back over the runs and return to the chunks as contributions per document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exactly, written

#: Texts of a chunk together, counted as bytes and ROW_BYTES a row; texts tokenized at a time.
CHUNK_BYTES, ROW_BYTES, SLICE_BYTES = 4_000_000, 64, 250_000
#: Powers of two: radix of the second id. Runs merged at a time.
RADIX, WIDTH = 32, 128
STATS = ("n_a", "n_b", "n_groups", "n_links")
SPILLED = pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), *[(s, pa.int64()) for s in STATS],
                     ("groups", pa.string()), ("radix", pa.int32()), ("pairs", pa.binary()), ("records", pa.binary())])
SPILLED_SQL = "chunk long, place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, radix int, pairs binary, records binary"
#: Longer texts are cut where neither tokenizer looks across.
SEGMENT = 32_768
_CUT = re.compile(r"(?<=\w)(?= \w)")
#: Letters, digits and marks that every version of the character tables files alike.
_SETTLED = re.compile("[\0-\u0377\u0400-\u0482\u0490-\u04F9\u2010-\u2027\u2030-\u205E\u20AC\u3001-\u3003\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5]*")


def packed(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays, one after the other, as one zstd frame."""
    import zstandard

    head = np.array([len(arrays), *[len(a) for a in arrays]], "<u8")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays))


def unpacked(frame: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(bytes(frame))
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<u8", n, 8).tolist(), 8 * (n + 1), []
    for size in sizes:
        planes = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<i8").astype(np.int64))
        at += 8 * size
    return out


class Bytewise:
    """First tokenizer: byte-level BPE of the ``tokenizers`` library. Special strings are plain text.

    Texts of settled characters go through ``tiktoken`` with the ranks of the same file, which cannot
    differ where merges are in the order of their ids, and every token's own bytes merge to that token. Then no two
    neighbours can ever stand for a token's bytes but the pair that the file lists for it, so that
    merging by the rank of the joined bytes is merging by the list.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        kind = json.loads(self.model.to_str())
        # words never reach from a letter over a blank
        self.cuts = (kind["pre_tokenizer"] or {}).get("type") == "ByteLevel" and kind["pre_tokenizer"].get("use_regex", True) and not kind["normalizer"]
        ids = kind["model"]["vocab"]
        joined = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in kind["model"]["merges"]]
        ranks = {self.bytes[i]: i for i in ids.values() if i not in {t["id"] for t in kind["added_tokens"]}}
        self.fast = None
        if self.cuts and joined == list(range(256, 256 + len(joined))) and len(ranks) == 256 + len(joined):
            alone = Tokenizer(self.model.model)  # without cutting into words
            if all(e.ids == [i] for i, e in zip(ids.values(), alone.encode_batch_fast(list(ids), add_special_tokens=False)) if self.bytes[i] in ranks):
                pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
                self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        fast = self.fast.encode_ordinary
        out = [fast(t) if t.isascii() or _SETTLED.fullmatch(t) else None for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.model.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out


class Pieces:
    """Second tokenizer: a sentencepiece model that puts a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        plain = [p for i, p in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.cuts = not any(re.search("[^▁]▁", p) for p in plain)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Every text begins with the blank that the model puts before it."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Tables:
    """Bytes and printed ids of one tokenizer."""

    def __init__(self, tokenizer, inner: str, last: str):
        self.tokenizer, self.bytes = tokenizer, tokenizer.bytes
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.line = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.inner = np.array([f"{i}{inner}" for i in range(len(self.bytes))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(self.bytes))], object)


def aligned(texts: list[str], a: Tables, b: Tables) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
    """Of each text, which begins with a blank: counts of tokens on both sides and of links, and its groups
    as text (None: without tokens); all links as pairs (second id, first id), and their texts."""
    counts, groups = np.zeros((len(texts), 3), np.int64), [None] * len(texts)
    if not texts:
        return counts, groups, np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = list(zip(range(len(texts)), *(t.tokenizer.encode(texts) for t in (a, b))))
    raw = [t.encode() for t in texts]

    whole = np.frombuffer(b"".join(raw), np.uint8)

    def spelled(side: int, table: Tables) -> bool:
        """Whether the tokens of every text spell it: all at once, since that is the rule."""
        flat = np.fromiter(chain.from_iterable(s[side] for s in same), np.int64)
        size = table.size[flat]
        end = np.append(0, np.cumsum(size))
        if end[-1] != len(whole) or (end[np.cumsum([len(s[side]) for s in same])] != np.cumsum([len(r) for r in raw])).any():
            return False
        return bool((table.line[np.repeat(table.begin[flat] - end[:-1], size) + np.arange(len(whole))] == whole).all())

    if not (spelled(1, a) and spelled(2, b)):
        same = [(k, x, y) for (k, x, y), r in zip(same, raw) if x and r == b"".join(map(a.bytes.__getitem__, x)) == b"".join(map(b.bytes.__getitem__, y))]
    if not same:
        return counts, groups, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, n_a, n_b = np.array([k for k, *_ in same]), np.array([len(x) for _, x, _ in same]), np.array([len(y) for *_, y in same])
    x, y = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in ([x for _, x, _ in same], [y for *_, y in same]))
    # the texts lie one after the other, so that ends are numbers of one line of bytes
    end_a, end_b = np.cumsum(a.size[x]), np.cumsum(b.size[y])
    at = np.searchsorted(end_a, end_b)
    meets = end_a[at] == end_b
    first, second, common = x[at[meets]], y[meets], end_b[meets]
    text = np.searchsorted(np.cumsum(n_b), np.flatnonzero(meets), side="right")
    counts[place] = np.stack([n_a, n_b, np.bincount(text, minlength=len(same))], axis=1)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    printed = np.empty(len(x) + len(y), object)
    printed[np.arange(len(x)) + np.searchsorted(group_b, group_a)] = np.where(common[group_a] == end_a, a.last[x], a.inner[x])
    printed[np.arange(len(y)) + np.searchsorted(group_a, group_b, side="right")] = np.where(meets, b.last[y], b.inner[y])
    begin = 0
    for k, n in zip(place.tolist(), (n_a + n_b).tolist()):
        groups[k] = "".join(printed[begin:begin + n].tolist())[:-1]
        begin += n
    return counts, groups, second << 32 | first, place[text]


def segments(text: str) -> list[str]:
    """A blank and the text, cut about every ``SEGMENT`` characters at places that neither tokenizer looks across."""
    text, out, begin = " " + text, [], 0
    while (m := _CUT.search(text, begin + SEGMENT)) is not None:
        out.append(text[begin:m.start()])
        begin = m.start()
    return [*out, text[begin:]]


def measured(texts: list[str | None], a: Tables, b: Tables) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """STATS of each text and the digest of its groups; all links, and the text of each.

    Groups never reach over a cut, since tokens of both sides end there.
    """
    cuts = a.tokenizer.cuts and b.tokenizer.cuts
    parts = [[] if not t else segments(t) if cuts else [" " + t] for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts, groups, pairs, part = aligned([x for p in parts for x in p], a, b)
    whole = np.ones(len(texts), bool)
    whole[owner[counts[:, 0] == 0]] = False  # a part is spelled otherwise: the text has no tokens
    stats = np.zeros((len(texts), 3), np.int64)
    np.add.at(stats, owner[whole[owner]], counts[whole[owner]])
    digests, begin = [], 0
    for n, ok in zip(sizes.tolist(), whole.tolist()):
        digests.append(hashlib.sha256(";".join(groups[begin:begin + n]).encode()).hexdigest() if n and ok else "")
        begin += n
    text = owner[part]
    return stats[:, [0, 1, 2, 2]], digests, pairs[whole[text]], text[whole[text]]


def runs(chunk: int, pair: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row per radix of the second id: its pairs with their counts, and its pair-document records."""
    known, inverse = np.unique(pair, return_inverse=True)
    order = np.lexsort((known, (known >> 32) & (RADIX - 1)))  # by radix, then by second id
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    both, n = np.unique(rank[inverse] << 32 | place, return_counts=True)  # one record per pair and document
    pair, place = known[order][both >> 32], both & 0xFFFFFFFF
    radix = (pair >> 32) & (RADIX - 1)
    bounds = np.searchsorted(radix, np.arange(RADIX + 1))
    found: dict[str, list] = {"radix": [], "pairs": [], "records": []}
    for r in range(RADIX):
        lo, hi = bounds[r], bounds[r + 1]
        if lo < hi:
            start = np.flatnonzero(np.diff(pair[lo:hi], prepend=-1))
            keys, total = pair[lo:hi][start], np.add.reduceat(n[lo:hi], start)
            found["radix"].append(r)
            found["pairs"].append(packed(np.diff(keys, prepend=0), total))
            found["records"].append(packed(np.diff(start, append=hi - lo), place[lo:hi], n[lo:hi]))
    rows = len(found["radix"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, chunk)), *[pa.nulls(rows, SPILLED.field(f).type) for f in ("place", "doc_id", *STATS, "groups")],
                                       pa.array(found["radix"], pa.int32()), pa.array(found["pairs"], pa.binary()), pa.array(found["records"], pa.binary())], schema=SPILLED)


def spilled(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (radix null) and of runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = Tables(Bytewise(a_path), ",", "|"), Tables(Pieces(b_path), ",", ";")
        chunk, used, place, pairs, places = TaskContext.get().partitionId() << 32, 0, 0, [], []
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            begin = 0
            while begin < len(texts):
                end, taken = begin, 0
                while end < len(texts) and (end == begin or taken < SLICE_BYTES):
                    taken += len(texts[end] or "") + ROW_BYTES
                    end += 1
                stats, digests, pair, text = measured(texts[begin:end], a, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(end - begin, chunk)), pa.array(np.arange(place, place + end - begin)), ids.slice(begin, end - begin),
                     *[pa.array(np.ascontiguousarray(s)) for s in stats.T], pa.array(digests, pa.string()),
                     *[pa.nulls(end - begin, SPILLED.field(f).type) for f in ("radix", "pairs", "records")]], schema=SPILLED)
                pairs.append(pair)
                places.append(text + place)
                place, used, begin = place + end - begin, used + taken, end
                if used >= CHUNK_BYTES:
                    yield runs(chunk, np.concatenate(pairs), np.concatenate(places))
                    chunk, used, place, pairs, places = chunk + 1, 0, 0, [], []
        if pairs:
            yield runs(chunk, np.concatenate(pairs), np.concatenate(places))

    rows = docs.select(exactly(id_col).cast("long").alias("doc_id"), exactly(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SPILLED_SQL)


def merged(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of several sorted runs and their counts, by a k-way heap."""
    def walk(frame: bytes):
        step, total = unpacked(frame)
        return zip(np.cumsum(step).tolist(), total.tolist())

    keys, totals = [], []
    for key, group in groupby(heapq.merge(*map(walk, frames)), itemgetter(0)):
        keys.append(key)
        totals.append(sum(n for _, n in group))
    return np.array(keys, np.int64), np.array(totals, np.int64)


def pair_counts(found: DataFrame, n_runs: int) -> DataFrame:
    """(radix, counts): all pairs of a radix with their counts, and whether they are the highest of their second id."""
    level = found.select("radix", F.col("chunk").alias("run"), "pairs")
    while n_runs > WIDTH:
        n_runs = -(-n_runs // WIDTH)

        def one(group: pd.DataFrame) -> pd.DataFrame:
            keys, totals = merged(group["pairs"].tolist())
            return pd.DataFrame({"radix": group["radix"].iloc[:1], "run": group["to"].iloc[:1], "pairs": [packed(np.diff(keys, prepend=0), totals)]})

        dealt = level.withColumn("to", F.pmod(F.xxhash64("run"), F.lit(n_runs)))
        level = dealt.groupBy("radix", "to").applyInPandas(one, "radix int, run long, pairs binary")

    def last(group: pd.DataFrame) -> pd.DataFrame:
        keys, totals = merged(group["pairs"].tolist())
        side = np.flatnonzero(np.diff(keys >> 32, prepend=-1))  # pairs come by second id
        top = np.repeat(np.maximum.reduceat(totals, side), np.diff(side, append=len(keys)))
        return pd.DataFrame({"radix": group["radix"].iloc[:1], "counts": [packed(np.diff(keys, prepend=0), totals, totals == top)]})

    return level.groupBy("radix").applyInPandas(last, "radix int, counts binary")


def contributions(found: DataFrame, counts: DataFrame, n_runs: int) -> DataFrame:
    """(chunk, given): per run, what its records add to each document of the chunk."""
    owners = -(-n_runs // WIDTH)
    owner = F.pmod(F.xxhash64("chunk"), F.lit(owners)).cast("int")
    mine = found.select("radix", owner.alias("owner"), "chunk", "pairs", "records")
    told = counts.withColumn("owner", F.explode(F.sequence(F.lit(0), F.lit(owners - 1))))

    def back(group: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        step, total, top = unpacked(table["counts"].iloc[0]) if len(group) else [np.zeros(0, np.int64)] * 3
        keys, given = np.cumsum(step), []
        for pairs, records in zip(group["pairs"], group["records"]):
            at = np.searchsorted(keys, np.cumsum(unpacked(pairs)[0]))
            held, place, n = unpacked(records)
            order = np.argsort(place, kind="stable")
            start = np.flatnonzero(np.diff(place[order], prepend=-1))
            given.append(packed(place[order][start], np.add.reduceat((np.repeat(top[at], held) * n)[order], start),
                                np.add.reduceat((np.repeat(total[at], held) * n)[order], start)))
        return pd.DataFrame({"chunk": group["chunk"], "given": given})

    return mine.groupBy("radix", "owner").cogroup(told.groupBy("radix", "owner")).applyInPandas(back, "chunk long, given binary")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``.

    ``a_path``: a byte-level BPE file of ``tokenizers``, which gets a blank and the text; ``b_path``: a
    sentencepiece model that puts the blank itself. Special strings in texts are text. Texts that are
    null or empty, or whose joined token bytes differ from blank and text on either side, have no
    tokens: zeros and an empty digest. Ids may be null or repeat, rows may repeat: each row counts.
    Texts over ``SEGMENT`` characters are tokenized in parts cut at single blanks between letters, which
    changes no token; one without such blanks is tokenized whole. Extra columns are ignored; an empty table gives no rows.
    """
    all_rows = written(spilled(docs, a_path, b_path, id_col, text_col), "spilled-runs")
    found = all_rows.where("radix IS NOT NULL")
    n_runs = max(1, found.agg(F.count_distinct("chunk")).first()[0])
    counts = written(pair_counts(found, n_runs), "pair-counts")
    given = contributions(found, counts, n_runs)
    rows = all_rows.where("radix IS NULL").select("chunk", "place", "doc_id", *STATS, "groups")

    def added(docs: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("place")
        best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for frame in given["given"]:
            place, top, n = unpacked(frame)
            best[place] += top
            total[place] += n
        out = docs[["doc_id", *STATS]].astype({"doc_id": "Int64"})
        return out.assign(n_best=best, count_sum=total, groups_sha256=docs["groups"])

    return rows.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(
        added, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
