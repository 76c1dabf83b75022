"""Counts and gradients of the language model from all training rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from vigilake.llm import maxent, queries


def test_all_training_rows_are_counted_and_corrected(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 20))), "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = [t for i, t, _ in rows if not held(i)]
    words = maxent.counted(docs.where(F.col("doc_id").isin([i for i, _, _ in rows if not held(i)])).select("text", F.lit("en").alias("grp"))).collect()
    v = maxent.Vocabulary([(r.word, r.c, r.grp) for r in words], sum(r.c for r in words), len(words))
    code, sizes, _, _ = v.encoded(texts)
    counts = np.zeros((maxent.FEATURES << v.bits, maxent.FAN), np.int64)
    at = maxent.positions(sizes)
    for _, _, child, found in maxent.steps(v, code, at):
        for r in found:
            np.add.at(counts, (r, child), 1)
    model = maxent.Model(v, counts)
    moved = np.zeros(counts.shape)
    for _, node, child, found in maxent.steps(v, code, at):
        g = -model.probabilities(v, node, found).astype(float)
        g[np.arange(len(g)), child] += 1
        for r in found:
            np.add.at(moved, r, g)
    model.weights += maxent.STEP * moved / (counts.sum(1, keepdims=True) + maxent.DAMP)
    want = {}
    for i, text, _ in rows:
        code, sizes, _, _ = v.encoded([text])
        want[i] = sum(np.log10(model.probabilities(v, node, found)[np.arange(len(node)), child]).sum()
                      for _, node, child, found in maxent.steps(v, code, maxent.positions(sizes)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.QUERIES["op3_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 * max(1, abs(want[i])) for i in want)
