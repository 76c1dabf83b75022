"""Quality rules with an isolation forest on rule statistics (operator 1).

Rule statistics of every document feed a forest of random splits. A document that few
splits set apart has a short mean path and a score near 1. Trees grow in Spark, one group
per tree, each from a hash sample of bounded size; the cut-off is set from the scores of
all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, exactly, written

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
          "n_short_lines", "n_digits", "n_upper", "n_punct"]
FEATURES = ["length", "word_length", "symbols", "dup_lines", "repeats", "distinct", "short_lines", "digits", "upper", "punct"]
PSI, TREES, DEPTH = 256, 100, 8
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one whole text; null has no words."""
    if text is None:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(raw.count(bytes([b])) for b in BLANKS)
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            times: dict[tuple, int] = {}
            for w in windows:
                times[w] = times.get(w, 0) + 1
            to = 0  # words before this one are counted already
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 5 - max(i, to)
                    to = i + 5
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (n, len(text) - blanks, sum(text.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated,
            len(lines), len(set(words)), sum(len(x) < 30 for x in lines), int(kinds[48:58].sum()), int(kinds[65:91].sum()),
            int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()))


def features(c: pd.DataFrame) -> np.ndarray:
    """Rule statistics per document, free of its length but for the first."""
    words, chars, lines = (np.maximum(c[k].to_numpy(float), 1) for k in ("n_words", "word_chars", "n_lines"))
    share = lambda k, of: c[k].to_numpy(float) / of
    return np.column_stack([
        np.log1p(c["n_words"].to_numpy(float)), chars / words, share("n_symbols", words), share("n_dup_lines", lines),
        share("n_repeat_words", words), share("n_distinct", words ** 0.8), share("n_short_lines", lines),
        share("n_digits", chars), share("n_upper", chars), share("n_punct", chars)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` per row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([counts_of(t) for t in batch["text"]], columns=COUNTS)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out.astype({"doc_id": "Int64"})

    return docs.select(exactly(id_col).cast("long").alias("doc_id"), exactly(text_col).cast("string").alias("text")).mapInPandas(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _average_path(n) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows, the forest's usual yardstick."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


def grow(x: np.ndarray, seed: int) -> list[tuple[int, float, int, int, float]]:
    """One tree as (feature, split, left, right, path length); leaves have feature -1."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        low, high = x[rows].min(0), x[rows].max(0)
        open_features = np.flatnonzero(high > low)
        if depth >= DEPTH or len(rows) < 2 or not len(open_features):
            nodes.append([-1, 0.0, at, at, depth + float(_average_path(len(rows)))])
            continue
        f = int(rng.choice(open_features))
        split = float(rng.uniform(low[f], high[f]))
        nodes.append([f, split, -1, -1, 0.0])
        left = x[rows, f] <= split
        todo += [(rows[left], depth + 1, at, 0), (rows[~left], depth + 1, at, 1)]
    return [tuple(n) for n in nodes]


class Forest:
    def __init__(self, trees: list[list[tuple]], psi: int, used: list[int]):
        self.used = used
        self.trees = [tuple(np.array(c) for c in zip(*t)) for t in trees if t]
        self.scale = float(_average_path(max(2, psi)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
        x = x[:, self.used]
        total = np.zeros(len(x))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= split[at], left[at], right[at])
            total += path[at]
        return np.round(2.0 ** (-total / max(1, len(self.trees)) / self.scale), 4)


def separating(stats: DataFrame, labels: DataFrame | None, least: float) -> list[int]:
    """Features whose means differ between good and bad rows by ``least`` standard deviations; all if none does.

    The forest splits on every feature alike, so features without bearing on quality only
    blur the paths. One aggregate over all labelled rows decides.
    """
    every = list(range(len(FEATURES)))
    if labels is None:
        return every

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(features(batch), columns=FEATURES).assign(quality=batch["quality"].to_numpy())

    rows = stats.join(labels, "doc_id").mapInPandas(run, ", ".join(f"{n} double" for n in FEATURES) + ", quality int")
    found = {r.quality: r for r in rows.groupBy("quality").agg(
        *[F.avg(n).alias(f"{n}_m") for n in FEATURES], *[F.var_pop(n).alias(f"{n}_v") for n in FEATURES]).collect()}
    if set(found) != {0, 1}:
        return every
    gap = lambda n: abs(found[1][f"{n}_m"] - found[0][f"{n}_m"]) / (((found[1][f"{n}_v"] + found[0][f"{n}_v"]) / 2) ** 0.5 + 1e-12)
    return [i for i in every if gap(FEATURES[i]) >= least] or every


def fit(stats: DataFrame, labels: DataFrame | None, trees: int, psi: int, least: float) -> Forest:
    """Trees from at most ``psi`` rows each, drawn by hash from all rows."""
    pool, used = stats, separating(stats, labels, least)
    n = pool.count()
    h = F.xxhash64(F.lit("forest"), *COUNTS, "doc_id")
    # about four times the rows needed survive the first cut, so no group is larger than a few psi
    bound = min(2 ** 63 - 1, int(min(1.0, 4 * trees * psi / max(1, n)) * 2 ** 64) - 2 ** 63)
    sample = pool.withColumn("_h", h).where(F.col("_h") <= bound).withColumn("tree", F.pmod(F.xxhash64("_h"), F.lit(trees)).cast("int"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h", *COUNTS], kind="stable").head(psi)
        rows = grow(features(group)[:, used], int(group["tree"].iloc[0]))
        return pd.DataFrame(rows, columns=["feature", "split", "left", "right", "path"]).assign(
            tree=int(group["tree"].iloc[0]), at=range(len(rows)))

    # bounded by trees * (2 * psi - 1) nodes
    grown = sample.groupBy("tree").applyInPandas(
        one, "feature int, split double, left int, right int, path double, tree int, at int").collect()
    found: dict[int, list] = {}
    for r in sorted(grown, key=lambda r: (r.tree, r.at)):
        found.setdefault(r.tree, []).append((r.feature, r.split, r.left, r.right, r.path))
    return Forest(list(found.values()), psi, used)


def threshold(scored: DataFrame, labels: DataFrame | None, clean_loss: float) -> float:
    """The score from which on documents are rejected, from all labelled rows.

    Of the cuts that reject at most ``clean_loss`` of the good rows, the one with the
    largest gap between bad and good rows rejected. No good or no bad row: no cut.
    """
    if labels is None:
        return 2.0
    # scores have four decimals: at most 10,001 groups
    rows = scored.join(labels, "doc_id").groupBy("score").agg(
        F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad")).collect()
    goods, bads = sum(r.good for r in rows), sum(r.bad for r in rows)
    best, cut, good, bad = 0.0, 2.0, 0, 0
    if goods and bads:
        for r in sorted(rows, key=lambda r: -r.score):
            good, bad = good + r.good, bad + r.bad
            if good <= clean_loss * goods and bad / bads - good / goods > best:
                best, cut = bad / bads - good / goods, r.score
    return cut


def trained(stats: DataFrame, labels: DataFrame | None, trees: int = TREES, psi: int = PSI,
            clean_loss: float = 0.002, least: float = 1.0) -> tuple[Forest, float]:
    """Forest and cut-off for rule statistics that were written to a table."""
    if labels is not None:
        labels = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    usable = stats.where(~F.expr(BASE))
    forest = fit(usable, labels, trees, psi, least)
    return forest, threshold(usable.mapInPandas(_scorer(forest), f"{_fields(stats)}, score double"), labels, clean_loss)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _scorer(forest: Forest):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=forest.score(features(batch))).astype({"doc_id": "Int64"})

    return run


def judged(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, score and kept per row of ``docs``.

    base_failed: fewer than 10 words, or more than a fifth of the words in 5-word windows
    that the text has twice. kept: not base_failed and below the calibrated score. Null and
    empty texts have no words and fail; repeated rows get equal verdicts; null ids are
    scored but never matched with a label; of several labels for an id the lowest counts;
    without good and bad labels the forest rejects nothing; an empty table gives no rows.
    """
    stats = written(statistics(docs, id_col, text_col), "rule-stats")
    forest, cut = trained(stats, labels, **options)
    return stats.mapInPandas(_scorer(forest), f"{_fields(stats)}, score double").withColumn("base_failed", F.expr(BASE)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") < cut))


def kept_documents(docs: DataFrame, labels: DataFrame | None, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) that ``judged`` keeps.

    The verdict is computed beside each row, so that no join has to tell repeated rows apart. Null and
    empty texts fail the base rules; null and equal ids are rows like any other; without labels the
    forest rejects nothing; an empty table gives no rows.
    """
    forest, cut = trained(written(statistics(docs), "rule-stats"), labels, **options)

    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        c = pd.DataFrame([counts_of(t) for t in text], columns=COUNTS)
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return ~failed & (forest.score(features(c)) < cut)

    return docs.where(keep(exactly("text")))
