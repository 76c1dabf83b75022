"""Byte windows of texts with NULs, against sets of strings."""

import hashlib
import random
from collections import Counter

from vigilake.llm import rounds, suffixes


def plain(rows, width=50):
    first = {}
    for doc, text in rows:
        b = text.encode()
        for k in range(len(b) - width + 1):
            first[b[k:k + width]] = min(first.get(b[k:k + width], doc), doc)
    out = Counter()
    for doc, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k:k + width]] < doc:
                gone[k:k + width] = b"\1" * width
        spans = sum(g and not p for g, p in zip(gone, [0, *gone]))
        out[(doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


def test_runs_of_nul(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "chunked", lambda d, i, t: rounds.chunked(d, i, t, 20_000))
    rng = random.Random(11)
    bodies = ["".join(rng.choice("ab\0") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    rows = []
    for i in range(1500):
        body = rng.choice(bodies)
        cut = rng.randint(0, 20)
        rows.append((i, "\0" * rng.choice([0, 0, 3, 30, 70]) + body[cut:] + "\0" * rng.choice([0, 1, 7, 20, 49, 50, 51, 90]) + rng.choice(["", "b", body[:30]])))
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(rows)
