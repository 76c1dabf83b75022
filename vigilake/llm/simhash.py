"""SimHash near-duplicates by a Gray-order hierarchical index (operator 10).

Fingerprints are reduced to distinct values. Two values at ``distance`` or fewer bits
agree wholly in some choice of ``shared`` of ``blocks`` blocks, so each value goes to one
group per choice. In a group the values are sorted by Gray rank, which puts values of few
differing bits side by side; bits on which a run of values agrees are factored into upper
nodes. A search adds up differences on the way down and leaves a whole run as soon as the
sum passes the distance, or takes it whole when no bit below can pass it. Groups give
star-shaped links; components follow from alternating star contractions in Spark.

``near_duplicates`` names the class of every row; ``without_near_duplicates`` keeps a row of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, exactly, free, partitions, written


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; none without words."""
    tokens = [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        shingles = []
    elif len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(h), 65536):
        ones += np.unpackbits(h[begin:begin + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); 0 without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and, if asked for, a key of its own per row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64).view(np.int64)
            yield batch.drop(columns="text").assign(fp=fp).astype({"doc_id": "Int64"})

    more = [] if key is None else [key.alias("key")]
    rows = docs.select(*more, exactly(id_col).cast("long").alias("doc_id"), exactly(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, ("key string, " if more else "") + "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each row of words in the reflected Gray code: the running exclusive or of its
    bits from the top, carried from word to word."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    for word in range(1, fp.shape[1]):
        rank[:, word] ^= np.uint64(0) - (rank[:, word - 1] & np.uint64(1))
    return rank


def gray_order(fp: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions sorted by group, then Gray rank."""
    rank = gray_rank(fp)
    return np.lexsort((*[rank[:, w] for w in reversed(range(fp.shape[1]))], group))


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """Trees over runs of values; ``group`` numbers the trees, values sorted by group, then Gray rank.

    A value is a row of 64-bit words. A level holds, per node, the bits on which all values
    below agree (``mask``) with their values, less those already held above it (``own``),
    and its range of children.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray, fanout: int = 4):
        value, mask, owner = fp, np.full(fp.shape, 0xFFFFFFFFFFFFFFFF, np.uint64), group
        first = np.arange(len(fp))
        levels = [[value, mask, None, None, first, first + 1]]  # leaves first; the last two: range of values below
        while True:
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(start) == len(owner):
                break
            size = np.diff(start, append=len(owner))
            inside = np.arange(len(owner)) - np.repeat(start, size)
            head = np.flatnonzero(inside % fanout == 0)
            tail = np.append(head[1:], len(owner))
            both = np.bitwise_and.reduceat(value, head) ^ np.bitwise_or.reduceat(value, head)
            agreed = np.bitwise_and.reduceat(mask, head) & ~both
            low, high = levels[-1][4][head], levels[-1][5][tail - 1]
            value, mask, owner = value[head] & agreed, agreed, owner[head]
            levels.append([value, mask, head, tail, low, high])
        self.levels, self.roots = levels, owner
        own = [levels[-1][1]]  # the bits a node adds to those of its parent
        for level in range(len(levels) - 1, 0, -1):
            above = np.repeat(levels[level][1], levels[level][3] - levels[level][2], axis=0)
            own.insert(0, levels[level - 1][1] & ~above)
        self.own = own
        self.room = [_bits(~level[1]) for level in levels]  # bits still open below a node

    def links(self, fp: np.ndarray, group: np.ndarray, distance: int, block: int = 1 << 14,
              label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions, linked directly or along a run, that join all within ``distance``.

        A run taken whole is given as links from the query to its first value and along the run:
        all its values lie within ``distance`` of the query, so they are one class. ``label``
        holds the classes so far, which the caller keeps up to date: neighbours in Gray order
        come first, and nodes wholly of the query's own class are left out, so that a large
        group of variants costs a few visits per value instead of all its pairs.
        """
        at = np.flatnonzero((group[1:] == group[:-1]) & (_bits(fp[1:] ^ fp[:-1]) <= distance)) if len(fp) > 1 else np.arange(0)
        yield at, at + 1
        root_of = np.searchsorted(self.roots, group)
        for begin in range(0, len(fp), block):
            one_class = None
            if label is not None:  # the class of all values below a node, or -1
                one_class = []
                for level in self.levels:
                    least, most = np.minimum.reduceat(label, level[4]), np.maximum.reduceat(label, level[4])
                    one_class.append(np.where(least == most, least, -1))
            query = np.arange(begin, min(begin + block, len(fp)))
            todo = [(len(self.levels) - 1, query, root_of[query], np.zeros(len(query), np.int64))]
            while todo:
                level, q, node, sum_ = todo.pop()
                value, mask, head, tail, low, high = self.levels[level]
                open_ = high[node] > q + 1  # each pair once: later values only
                if one_class is not None:
                    open_ &= one_class[level][node] != label[q]
                q, node, sum_ = q[open_], node[open_], sum_[open_]
                sum_ = sum_ + _bits((fp[q] ^ value[node]) & self.own[level][node])
                near = sum_ <= distance
                q, node, sum_ = q[near], node[near], sum_[near]
                whole = sum_ + self.room[level][node] <= distance
                if whole.any():
                    a, lo, hi = q[whole], low[node[whole]], high[node[whole]]
                    lo = np.maximum(lo, a + 1)
                    yield a, lo
                    longer = np.unique(np.stack([lo, hi]), axis=1)
                    span = longer[1] - longer[0] - 1
                    at = np.repeat(longer[0], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                    yield at, at + 1
                q, node, sum_ = q[~whole], node[~whole], sum_[~whole]
                if not len(q):
                    continue
                count = tail[node] - head[node]
                child = np.repeat(head[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                q, sum_ = np.repeat(q, count), np.repeat(sum_, count)
                step = (1 << 20) // fp.shape[1]
                for cut in range(0, len(q), step):  # bounds what is held at once
                    part = slice(cut, cut + step)
                    todo.append((level - 1, q[part], child[part], sum_[part]))


class Classes:
    """Classes of positions under links that arrive in batches: label propagation with shortcuts."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def star_links(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Rows (part, key, id, fp) sorted by part and key -> links of each id to one of its class.

    ``fp`` is the value as bytes, highest first."""
    rest = None

    def solve(part, key, ids, fp):
        group = np.cumsum(np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]))) - 1
        keep = np.bincount(group)[group] > 1
        group, ids, fp = np.unique(group[keep], return_inverse=True)[1].reshape(-1), ids[keep], fp[keep]
        if not len(fp):
            return None
        order = gray_order(fp, group)
        fp, group, ids = fp[order], group[order], ids[order]
        index, classes = GrayIndex(fp, group), Classes(len(fp))
        for a, b in index.links(fp, group, distance, label=classes.label):
            classes.add(a, b)
        linked = classes.label != np.arange(len(fp))
        return pd.DataFrame({"u": ids[linked], "v": ids[classes.label[linked]]})

    for batch in batches:
        if not len(batch):
            continue
        new = [batch[c].to_numpy() for c in ("part", "key", "id")]
        new.append(np.frombuffer(b"".join(batch["fp"]), ">u8").astype(np.uint64).reshape(len(batch), -1))
        part, key, ids, fp = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
        last = int(np.flatnonzero((part != part[-1]) | (key != key[-1]))[-1]) + 1 if (part[0], key[0]) != (part[-1], key[-1]) else 0
        rest = [part[last:], key[last:], ids[last:], fp[last:]]
        if last and (out := solve(part[:last], key[:last], ids[:last], fp[:last])) is not None:
            yield out
    if rest is not None and (out := solve(*rest)) is not None:
        yield out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for all values with a link: alternating large-star and small-star steps.

    Every step aggregates minima and joins them back; the edges are written after each
    round. A step moves all links of a value to its lowest neighbour, so a long chain
    shrinks by a factor per round.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small, "links")
        # stars only: no centre is a member of another star and every member has one centre
        open_ends = new.select(F.col("v").alias("u")).distinct().join(new, "u", "left_semi").take(1)
        many = new.groupBy("u").count().where("count > 1").take(1)
        edges = new
        if not open_ends and not many:
            return edges.select("u", F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _rooted(keyed: DataFrame, values: DataFrame, distance: int) -> DataFrame:
    """Values with (part, key) groups -> the same values with the root of their class."""
    links = (keyed.repartition(partitions(values.sparkSession), "part", "key").sortWithinPartitions("part", "key")
             .mapInPandas(lambda batches: star_links(batches, distance), "u long, v long"))
    roots = components(links).withColumnRenamed("u", "id")
    return values.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def classes(values: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(fp, root) for distinct values of 64 bits: the lowest value reachable over links."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        m = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in chosen)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    plain = values.select(F.col("fp").alias("id"))
    keyed = plain.select("id", F.posexplode(F.array(*[F.col("id").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("part", "key"))
    fp = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    return _rooted(keyed.select("part", "key", "id", fp.alias("fp")), plain, distance).withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id per row: the smallest id reachable over links of ``distance`` or fewer bits.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Equal
    texts, repeated rows and equal ids are rows of their own with one class. Null ids get a
    class but never name one, unless the class has no other id (then it is null). Extra
    columns are ignored; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes(values, distance, blocks).join(values, "fp")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(named.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "classes")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row of every class of ``near_duplicates``: that of the smallest id (null ids last), then of
    the smallest text hash.

    Rows are told apart by id and text; of rows equal in both one stays. All columns of ``docs`` are
    kept, whatever their names. Texts without words, null ones included, have fingerprint 0 and are
    linked like any other; an empty table gives no rows. Only the rows that go, or that occur more
    than once, are joined back to the texts.
    """
    columns = [exactly(c) for c in docs.columns]
    name, state = free(docs, "row_key"), free(docs, "row_state")
    key = F.concat_ws("/", F.sha2(F.coalesce(exactly("text").cast("string"), F.lit("")), 256), exactly("doc_id").cast("string"))
    rows = written(fingerprints(docs, words, key=key), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    values = rows.groupBy("fp").agg(first)
    named = classes(values, distance, blocks).join(values, "fp")
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"), F.lit(True).alias("stays"))
    told = rows.groupBy("key").count().join(chosen, "key", "left").where("stays IS NULL OR count > 1")
    told = written(told.select(F.col("key").alias(name), F.coalesce("stays", F.lit(False)).alias(state)), "verdicts")
    # verdicts grow with the rows: they are joined by a shuffle whatever their number, never broadcast
    marked = docs.withColumn(name, key).join(told.hint("merge"), name, "left")
    several = marked.where(F.col(state)).dropDuplicates([name])
    return marked.where(F.col(state).isNull()).select(columns).union(several.select(columns))
