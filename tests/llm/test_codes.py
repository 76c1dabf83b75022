"""Texts are cut into words for their counts and for their codes, and not again."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vigilake.llm import maxent
from vigilake.llm.common import LOWER

TEXTS = ["the cat", "", None, " \t\x0b The\x0cCAT\r\nsat \x1c\x85 ", "\x00 cat\x00 　 zebra é zebra the \U0001f600", "  ", "xy z " * 700 + "cat", "ÀB Àb àb"]


def vocabulary():
    words = [("the", 40, "en"), ("cat", 30, "en"), ("àb", 9, "fr"), ("xy", 5, "en"), ("", 20, "en")]
    return maxent.Vocabulary(words, sum(c for _, c, _ in words) + 7, 9)


def plain(v, texts):
    """Codes and rare words of every text, word by word."""
    n, start, end = len(v.code), len(v.code) + maxent.SUFFIXES, len(v.code) + maxent.SUFFIXES + 1
    codes, rare = [], []
    for text in texts:
        words = (text or "").encode().translate(LOWER).split()
        codes.append([start, start] + [v.code.get(w, n + int.from_bytes(w[-3:], "little") * 40503 % 65521 % maxent.SUFFIXES) for w in words] + [end])
        rare.append([w for w in words if w not in v.code])
    return codes, rare


def test_codes_equal_plain(spark):
    v = vocabulary()
    codes, rare = plain(v, TEXTS)
    whole = pa.array(["cut off"] + TEXTS)
    for texts in (TEXTS, whole.slice(1), whole.cast(pa.large_string()).slice(1)):
        code, sizes, words, places = v.encoded(texts)
        assert code.tolist() == sum(codes, []) and sizes.tolist() == [len(c) - 2 for c in codes]
        assert [w.encode() for w in words.to_pylist()] == sum(rare, []) and len(places) == len(words)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "row long, text string").coalesce(1)
    rows = sorted(maxent.coded(docs, spark.sparkContext.broadcast(v)).collect())
    code, sizes = v.decoded(pa.array([bytes(r.codes) for r in rows], pa.binary()))
    assert code.tolist() == sum(codes, []) and sizes.tolist() == [r.n_tokens for r in rows]
    assert [dict(zip(r.words, r.times)) for r in rows] == [Counter(w.decode() for w in x) for x in rare]
    assert [(r.n_rare, r.known) for r in rows] == [(len(x), len(c) - 2 - len(x)) for x, c in zip(rare, codes)]
    assert np.allclose([r.base for r in rows], [sum(v.count_log[x] for x in c[2:-1] if x < len(v.code)) + np.log10(21) for c in codes])


def test_texts_are_read_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def said(text):
        read.add(1)
        return text

    rows = [(i, "a b c d " * (i % 9), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("text", F.udf(said, "string").asNondeterministic()("text"))
    assert maxent.scored(docs, whole=True).count() == 60
    assert 0 < read.value <= 120
