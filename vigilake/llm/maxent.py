"""Language-model scoring with a hashed maximum-entropy model (operator 3).

P(word | context) is a product of softmaxes down a tree of classes: of all words in classes, of a class
in finer ones, until a class is a single word. Classes are runs of a list ordered by group and count,
cut into parts of about equal mass, so that frequent words need few steps. Every softmax looks at
hashed features of the context together with its class: the last word, the last two and, for the first
choice, the word before the last alone (a skip). Its logits are the class's own log shares, and a row of weights per
feature; a row's confidence says how far it may replace the shares.

Texts are cut into words once for the counts of words and once for their codes, which are written;
all that follows reads these. Training reads all training rows twice, or disjoint slices of them, dealt by a hash of the row and not
by task. At the shares themselves the gradient of a row is what was
counted after it less what was expected, so the first update is solved from whole-number counts,
which Spark sums by row. Then every token's softmax is computed with these weights, once for equal
contexts of a piece of text, and the gradients, summed by row, move them once more.
Words too rare for the bounded table of frequent words share one leaf; their counts reach the
documents by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, exactly, partitions, written

END = ""  # no word is empty
#: A frequent word holds this share of all training tokens at least, so there are at most 1,000,000.
SHARE = 1e-6
#: Children of a class; codes for rare words by their last bytes; leaves of the end and of rare words.
FAN, SUFFIXES, STOP, TAIL = 24, 4096, 0, 1
FEATURES = 3  # tables; the third serves the first choice alone
#: How far the rows of each feature may replace the shares, how many tokens make half of that, and
#: what every child has beside its count.
SCALE, HALF, EXTRA = (0.45, 0.3, 0.15), 4.0, 0.05
#: Without ``whole`` one row of so many goes into the second slice; step of its update, and what damps rows seldom met.
SLICES, STEP, DAMP = 10, 1.0, 4.0
NEVER = -1e4
#: Rows of the tables that are worked on at a time; bytes of texts, and of codes, which have three each.
BLOCK, TEXTS, CODES = 1 << 14, 4 << 20, 3 << 20


def counted(docs: DataFrame, held: int = 1_000_000) -> DataFrame:
    """(word, grp, c) over ``text`` and ``grp``: partial counts of bounded size per task, summed by word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}
        since = 0  # characters since the size was last looked at

        def out():
            return pd.DataFrame([(w.decode("utf-8", "surrogatepass"), g, n) for g, c in counts.items() for w, n in c.items()], columns=["word", "grp", "c"])

        for batch in batches:
            for text, group in zip(batch["text"], batch["grp"]):
                c = counts.setdefault(group, Counter())
                c.update((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
                c[b""] += 1
                since += len(text or "")
                if since > 1_000_000 and sum(map(len, counts.values())) > held:
                    yield out()
                    counts.clear()
                since = 0 if since > 1_000_000 else since
        yield out()

    parts = docs.mapInPandas(run, "word string, grp string, c long").repartition(partitions(docs.sparkSession), "word")
    return parts.groupBy("word", "grp").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words, the tree of classes over them, and numbers of the whole."""

    def __init__(self, words: list[tuple[str, int, str]], total: int, kinds: int):
        self.total, self.kinds = total, kinds
        mass: Counter = Counter()
        for _, c, g in words:
            mass[g] += c
        main = {g: i for i, (g, _) in enumerate(sorted(mass.items(), key=lambda x: (-x[1], x[0]))[:7])}
        ranked = sorted((main.get(g, len(main)), -c, w) for w, c, g in words if w != END)
        self.code = {w.encode("utf-8", "surrogatepass"): i for i, (_, _, w) in enumerate(ranked)}
        self.words = pa.array(self.code, pa.large_binary())
        self.count = np.array([-c for _, c, _ in ranked], np.int64)
        self.end_count = next((c for w, c, _ in words if w == END), 0)
        self.tail_total = total - int(self.count.sum()) - self.end_count
        self.tail_kinds = kinds - len(ranked) - (self.end_count > 0)
        self.count_log = np.log10(self.count + 1.0)
        self.bits = max(13, math.ceil(math.log2(max(1, len(ranked)))) - 2)  # the tables grow with the vocabulary
        self.grow(np.concatenate([[self.end_count + 1, self.tail_total + 1], self.count]).astype(np.float64))

    def grow(self, mass: np.ndarray) -> None:
        """Classes of runs of leaves: the class and child of every step to a leaf, and shares of children."""
        before = np.concatenate([[0.0], np.cumsum(mass)])
        steps: list[list[tuple[int, int, int, int]]] = []  # per depth: class, child, first and last leaf
        shares, todo, classes = [], [(0, len(mass), 0)], 1
        while todo:
            level, later = [], []
            for lo, hi, node in todo:
                if hi - lo <= FAN:
                    edges = list(range(lo, hi + 1))
                else:
                    aims = before[lo] + (before[hi] - before[lo]) * np.arange(1, FAN) / FAN
                    cuts = np.searchsorted(before[lo + 1:hi], aims) + lo + 1
                    inner = sorted({int(c) for c in cuts if lo < c < hi})
                    edges = [lo, *(inner or [hi - 1]), hi]  # without a cut the last leaf outweighs all
                row = np.full(FAN, NEVER)
                for child, (a, b) in enumerate(zip(edges, edges[1:])):
                    row[child] = math.log((before[b] - before[a]) / (before[hi] - before[lo]))
                    level.append((node, child, a, b))
                    if b - a > 1:
                        later.append((a, b, classes))
                        classes += 1
                shares.append((node, row))
            steps.append(level)
            todo = later
        self.shares = np.stack([r for _, r in sorted(shares, key=lambda x: x[0])]).astype(np.float32)
        self.node = np.full((len(steps), len(mass)), -1, np.int32)
        self.child = np.zeros((len(steps), len(mass)), np.int8)
        for depth, level in enumerate(steps):
            for node, child, a, b in level:
                self.node[depth, a:b], self.child[depth, a:b] = node, child

    def encoded(self, texts) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Codes of all texts one after the other, two starts before each; lengths; rare words and their places."""
        n, start, end = len(self.code), len(self.code) + SUFFIXES, len(self.code) + SUFFIXES + 1
        words, sizes = split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        sizes += 1
        code = np.full(int((sizes + 2).sum()), start, np.int64)
        last = np.cumsum(sizes + 2) - 1
        code[last] = end
        place = positions(sizes)
        place = place[code[place] != end]
        code[place] = pc.index_in(words.cast(pa.large_binary()), value_set=self.words).fill_null(-1).to_numpy()
        unknown = np.flatnonzero(code[place] < 0)
        rare, words = place[unknown], words.take(pa.array(unknown))
        if len(rare):
            # a rare word speaks through its last three bytes
            ends, text = raw(words)
            size, value = np.diff(ends), np.zeros(len(rare), np.int64)
            for back in (3, 2, 1):
                has = size >= back
                value[has] |= text[ends[1:][has] - back].astype(np.int64) << 8 * (np.minimum(size[has], 3) - back)
            code[rare] = n + value * 40503 % 65521 % SUFFIXES
        return code, sizes, words, rare

    def decoded(self, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts as ``encoded`` gives them, and lengths, from those that were written."""
        ends, low = raw(codes)
        sizes = np.diff(ends) // 3
        wide = np.zeros((int(sizes.sum()), 4), np.uint8)
        wide[:, :3] = low[ends[0]:ends[-1]].reshape(-1, 3)
        code = np.full(len(wide) + 2 * len(sizes), len(self.code) + SUFFIXES, np.int64)
        code[positions(sizes)] = wide.view("<u4").ravel()
        return code, sizes

    def leaves(self, code: np.ndarray) -> np.ndarray:
        n = len(self.code)
        return np.where(code < n, code + 2, np.where(code == n + SUFFIXES + 1, STOP, TAIL))

    def rows(self, code: np.ndarray, at: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """Rows of the weights for contexts and classes: last word, last two and, in the first class, skip."""
        return self.rows_after(code[at - 1], code[at - 2], node)

    def rows_after(self, last: np.ndarray, before: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        a, b = last.astype(np.uint64), before.astype(np.uint64)
        spread = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out, first = [], bool(len(node)) and int(node[0]) == 0
        for f, key in enumerate((a, a * np.uint64(1_000_003) + b, b) if first else (a, a * np.uint64(1_000_003) + b)):
            h = (key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= spread
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h >>= np.uint64(64 - self.bits)
            out.append(h.astype(np.int64) + (f << self.bits))
        return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of a column of strings or bytes begin, with the end of the last, and the bytes of all."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    return ends, np.frombuffer(data or b"", np.uint8)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, lower-cased, one after the other, and how many each text has. Arrow cuts at the
    six ASCII blanks, too, but leaves empty words at both ends of a text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts).fill_null(""))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return words.filter(pa.array(full)), np.diff(before[ends])


def steps(v: Vocabulary, code: np.ndarray, at: np.ndarray, size: int = 1 << 14) -> Iterator[tuple]:
    """Places (among ``at``), classes, children and weight rows of all softmaxes, a bounded number at a time;
    the first class alone, then those of each depth."""
    for begin in range(0, len(at), size):
        part = at[begin:begin + size]
        leaf = v.leaves(code[part])
        for depth in range(len(v.node)):
            node = v.node[depth, leaf]
            use = np.flatnonzero(node >= 0)
            if not len(use):
                break
            yield use + begin, node[use], v.child[depth, leaf[use]].astype(np.int64), v.rows(code, part[use], node[use])


class Model:
    """Weights and how far each row replaces the shares."""

    def __init__(self, v: Vocabulary, counts: np.ndarray):
        self.part = np.zeros(len(counts), np.float32)
        self.weights = np.zeros(counts.shape, np.float32)
        for begin in range(0, len(counts), BLOCK):  # whole tables in doubles would fill the driver
            at = slice(begin, begin + BLOCK)
            seen = counts[at].sum(1, keepdims=True).astype(np.float64)
            scale = np.array(SCALE)[np.arange(begin, begin + len(seen)) >> v.bits][:, None] * (seen / (seen + HALF))
            self.part[at] = scale[:, 0]
            self.weights[at] = scale * np.log((counts[at] + EXTRA) / (seen + FAN * EXTRA))

    def softmax(self, v: Vocabulary, node: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the logits, child by child, and their sums, which they are to be divided by."""
        left = 1 - self.part[rows[0]]
        for r in rows[1:]:
            left -= self.part[r]
        x = v.shares.take(node, 0, mode="clip")
        x *= left[:, None]
        some = np.empty_like(x)
        for r in rows:
            x += self.weights.take(r, 0, some, "clip")
        x = np.ascontiguousarray(x.T)  # along long rows all that follows is several times faster
        x -= x.max(0)
        np.exp(x, out=x)
        # eight sums, then those: the order of x.T.sum(1), the same wherever a context stands
        y = x[:8].copy()
        for k in range(8, FAN, 8):
            y += x[k:k + 8]
        return x, ((y[0] + y[1]) + (y[2] + y[3])) + ((y[4] + y[5]) + (y[6] + y[7]))

    def probabilities(self, v: Vocabulary, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        x, below = self.softmax(v, node, rows)
        x /= below
        return x.T


def positions(sizes: np.ndarray) -> np.ndarray:
    """Places of the tokens in the codes: all but the two starts of each text."""
    total = int((sizes + 2).sum())
    use = np.ones(total, bool)
    head = np.cumsum(sizes + 2) - sizes - 2
    use[head] = use[head + 1] = False
    return np.flatnonzero(use)


def pieces(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of so many bytes, or of one row."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, size + (ends[begin - 1] if begin else 0), side="right")))
        yield begin, end
        begin = end


def coded(docs: DataFrame, vocabulary) -> DataFrame:
    """Codes of each text, three bytes a token, instead of the text; its numbers of tokens, of known and of rare ones;
    logs of the counts of frequent words, summed; the rare words and how often each occurs."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            for a, b in pieces(batch["text"], TEXTS):
                part = batch.slice(a, b - a)
                code, sizes, words, rare = v.encoded(part["text"])
                head, tokens = np.cumsum(sizes) - sizes, code[positions(sizes)]
                leaf = v.leaves(tokens)
                hot, stop = leaf > TAIL, leaf == STOP
                base = np.zeros(len(tokens))
                base[hot] = v.count_log[tokens[hot]]
                base[stop] = math.log10(v.end_count + 1)
                known = np.add.reduceat((hot | (stop & (v.end_count > 0))).astype(np.int64), head)
                # equal rare words of a text are one
                doc = np.searchsorted(np.cumsum(sizes + 2), rare, side="right")
                words = words.dictionary_encode()
                kinds = max(1, len(words.dictionary))
                key, times = np.unique(doc * kinds + words.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * kinds), pa.int32())
                low = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
                cuts = 3 * np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({c: part[c] for c in kept} | {
                    "n_tokens": pa.array(sizes), "known": pa.array(known), "base": pa.array(np.add.reduceat(base, head)),
                    "n_rare": pa.array(np.bincount(doc, minlength=len(sizes))),
                    "words": pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(key % kinds)).cast(pa.string())),
                    "times": pa.ListArray.from_arrays(ends, pa.array(times)),
                    "codes": pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(low)])})

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join(fields) + ", n_tokens long, known long, base double, n_rare long, words array<string>, times array<long>, codes binary")


def summed(docs: DataFrame, run, kind: str, bits: int) -> np.ndarray:
    """Tables of all tasks, (row, one column per child), added."""
    names = [f"c{k}" for k in range(FAN)]
    found = docs.select("codes").mapInArrow(run, "row int, " + ", ".join(f"{n} {kind}" for n in names))
    sums = found.groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    table = np.zeros((FEATURES << bits, FAN), np.int64 if kind == "int" else np.float64)
    for batch in sums.toArrow().to_batches():
        table[batch.column("row").to_numpy()] = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
    return table


def sent(columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with anything in them of a table that lies child by child."""
    touched = np.flatnonzero(columns.any(0))
    for begin in range(0, len(touched), 50_000):
        row = touched[begin:begin + 50_000]
        yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int32())} | {f"c{k}": pa.array(c[row]) for k, c in enumerate(columns)})


def observed(docs: DataFrame, vocabulary) -> np.ndarray:
    """How often each child was met in each row: whole numbers, the same however the rows are dealt out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        counts = np.zeros((FEATURES << v.bits) * FAN, np.int32)
        one = np.int32(1)  # a plain 1 would be cast for every place
        for batch in batches:
            for a, b in pieces(batch["codes"], CODES):
                code, sizes = v.decoded(batch["codes"].slice(a, b - a))
                for _, _, child, rows in steps(v, code, positions(sizes)):
                    for r in rows:
                        np.add.at(counts, r * FAN + child, one)
        yield from sent(counts.reshape(-1, FAN).T)

    return summed(docs, run, "int", vocabulary.value.bits)


def contexts(v: Vocabulary, code: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple]:
    """Classes, weight rows and numbers of the distinct contexts of all softmaxes, a bounded number at a time.
    What a model expects depends on the two words before and the class alone."""
    kinds = len(v.code) + SUFFIXES + 2
    leaf, pair = v.leaves(code[at]), code[at - 1] * kinds + code[at - 2]
    for depth in range(len(v.node)):
        node = v.node[depth, leaf]
        use = np.flatnonzero(node >= 0)
        if not len(use):
            break
        key = node[use].astype(np.int64) * (kinds * kinds) + pair[use]
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(first, append=len(key))
        key = key[first]
        for begin in range(0, len(key), size):
            some = key[begin:begin + size]
            left, before = np.divmod(some, kinds)
            node, last = np.divmod(left, kinds)
            yield node, v.rows_after(last, before, node), times[begin:begin + size]


def expected(docs: DataFrame, vocabulary, model) -> np.ndarray:
    """Per row, the sum of what the model expects after each token of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocabulary.value, model.value
        rows_of = 1 << v.bits
        sums = np.zeros((FAN, FEATURES << v.bits))  # child by child
        p = np.empty((FAN, 2 * rows_of))  # so adding tables costs less than filling them
        for batch in batches:
            for a, b in pieces(batch["codes"], CODES):
                code, sizes = v.decoded(batch["codes"].slice(a, b - a))
                for node, rows, times in contexts(v, code, positions(sizes), p.shape[1]):
                    for begin in range(0, len(node), BLOCK):
                        at = slice(begin, begin + BLOCK)
                        # of single precision, so that the sums of few of them are short where Spark packs them
                        x = m.probabilities(v, node[at], [r[at] for r in rows]).T
                        np.multiply(x, times[at], out=p[:, begin:begin + x.shape[1]])
                    for f, r in enumerate(rows):
                        r = r - f * rows_of
                        for k in range(FAN):
                            sums[k, f * rows_of:(f + 1) * rows_of] += np.bincount(r, p[k, :len(r)], rows_of)
        yield from sent(sums)

    return summed(docs, run, "double", vocabulary.value.bits)


def trained(first: DataFrame, second: DataFrame, vocabulary) -> Model:
    """Weights solved from the counts of the first rows (column codes) and moved by the gradients of the
    second, which may be the same. The driver holds the tables, which are bounded by the vocabulary,
    not by the text."""
    counts = observed(first, vocabulary)
    model = Model(vocabulary.value, counts)
    if second is not first:
        counts = observed(second, vocabulary)
    shared = first.sparkSession.sparkContext.broadcast(model)
    sums = expected(second, vocabulary, shared)
    # rounded, so that the order in which Spark adds cannot show
    for begin in range(0, len(sums), BLOCK):
        at = slice(begin, begin + BLOCK)
        seen = counts[at].sum(1, keepdims=True)
        model.weights[at] = np.round(model.weights[at] + STEP * (counts[at] - sums[at]) / (seen + DAMP), 6)
    return model


def scored(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
           whole: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of ``docs``.

    A row is held out from training if crc32 of its id as text leaves 2 modulo 7; a null id
    is never held out. Null and empty texts are one end token. Repeated rows count as often
    as they occur and score alike, and scores do not depend on how the rows are partitioned.
    ``group_col`` only shapes the classes; where the column is missing or null there is one group. Other columns are ignored. With no training rows
    all words are unknown; an empty table gives no rows. ``whole`` learns counts and gradients from all
    training rows each; otherwise each row serves one of them, which is cheaper.
    """
    spark: SparkSession = docs.sparkSession
    group = exactly(group_col).cast("string") if group_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(exactly(id_col).cast("long").alias("doc_id"), exactly(text_col).cast("string").alias("text"), F.coalesce(group, F.lit("")).alias("grp"))
    remainder = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)), F.lit(0))
    rows = rows.withColumn("held_out", remainder == 2)
    train = rows.where(~F.col("held_out"))
    words = written(counted(train).groupBy("word").agg(F.sum("c").alias("c"), F.max(F.struct("c", "grp"))["grp"].alias("grp")), "word-counts")
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # each holds SHARE of all tokens, so there are at most 1 / SHARE of them
    frequent = [(r.word, r.c, r.grp) for r in words.where((F.col("c") >= total * SHARE) | (F.col("word") == END)).collect()]
    vocabulary = spark.sparkContext.broadcast(Vocabulary(frequent, total, kinds))
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SLICES)).cast("int")
    codes = written(coded(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", part.alias("slice"), "text"), vocabulary), "codes")
    first = second = codes.where(~F.col("held_out"))
    if not whole:
        first, second = (first.where(x) for x in (F.col("slice") > 0, F.col("slice") == 0))
    model = spark.sparkContext.broadcast(trained(first, second, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocabulary.value, model.value
        for batch in batches:
            for a, b in pieces(batch["codes"], CODES):
                part = batch.slice(a, b - a)
                code, sizes = v.decoded(part["codes"])
                at = positions(sizes)
                logs = np.zeros(len(at))
                for use, node, child, r in steps(v, code, at):
                    x, below = m.softmax(v, node, r)
                    logs[use] += np.log10(np.maximum(x[child, np.arange(len(child))] / below, 1e-30))
                yield pa.RecordBatch.from_pydict({c: part[c] for c in kept} | {"model": pa.array(np.add.reduceat(logs, np.cumsum(sizes) - sizes))})

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "n_rare"]
    half = written(codes.select(*kept, "codes").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, n_rare long, model double"), "scores")
    rare = codes.select("row", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", F.col("r.words").alias("word"), F.col("r.times").alias("n"))
    found = rare.join(words.where((F.col("c") < total * SHARE) & (F.col("word") != END)).select("word", "c"), "word")
    found = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"), F.sum("n").alias("n"))
    v = vocabulary.value
    log = F.coalesce("log", F.lit(0.0))
    return half.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"),
        (F.col("model") + log - F.col("n_rare") * math.log10(v.tail_total + v.tail_kinds + 1)).alias("score"))
