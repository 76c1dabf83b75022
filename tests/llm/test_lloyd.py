"""Codebooks and codes against plain Python on whole numbers."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigilake.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, salt string, part string"


def plain(rows, n_parts=4, n_entries=256, rounds=4):
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 19 for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(good[0][1])
    good = [r for r in good if len(r[1]) == dim]
    whole = [[math.floor(1024 * x) for x in r[1]] for r in good]
    cut = [dim * k // n_parts for k in range(n_parts + 1)]
    parts = [[w[a:b] for w in whole] for a, b in zip(cut, cut[1:])]
    books = [[list(x) for x in p[:n_entries]] for p in parts]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p, mine in enumerate(parts):
            held = defaultdict(list)
            for x in mine:
                held[nearest(p, x)[1]].append(x)
            for k, m in held.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m)]
    found = [[nearest(p, parts[p][i]) for p in range(n_parts)] for i in range(len(good))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for r, e in zip(good, errors):
        by_label[r[2]] += e
    out = Counter((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]]) for r, f, e in zip(good, found, errors))
    return out, books


def made(n, dim, scale=1.0):
    rng = random.Random(dim)
    say = lambda: [float(np.float32(rng.gauss(0, scale))) for _ in range(dim)]
    hot = say()
    rows = [(i * 3 % 1009, hot if i % 3 == 0 else say(), rng.choice([0, 1, None]), *"abcd") for i in range(n)]
    broken = [None, [], [None] * dim, [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [1e30] * dim, [0.5] * (dim + 1)]
    rows += [(2000 + i, v, 1, *"abcd") for i, v in enumerate(broken)]
    return rows + [rows[1], (None, say(), None, *"abcd"), (rows[2][0], say(), 0, *"abcd"), (5000, [0.0] * dim, 7, *"abcd"), (5001, [-0.0] * dim, 7, *"abcd")]


@pytest.mark.parametrize("n, dim, entries, scale", [(200, 8, 16, 1), (90, 10, 256, 1), (120, 8, 12, 40_000), (30, 3, 4, 1)])
def test_equals_plain(spark, n, dim, entries, scale):
    rows = made(n, dim, scale)
    rows = rows if scale == 1 else [r for r in rows if not r[1] or r[1][0] != 1e30]
    want, books = plain(rows, n_entries=entries)
    coded, got = lloyd.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3), n_entries=entries)
    assert Counter((r.id, r.code, r.error, r.label_error) for r in coded.collect()) == want
    assert [e.tolist() for e in got.entries] == books


def test_empty(spark):
    for rows in ([], [(1, None, 1, *"abcd")]):
        coded, books = lloyd.compressed(spark.createDataFrame(rows, SCHEMA))
        assert coded.collect() == [] and books is None and "label_error" in coded.columns
