"""Line dedup against a plain version: hot lines over many partitions, ties, repeats, nulls, long texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigilake.llm import linededup

SCHEMA = "doc_id long, text string, row string, n_lines string, h1 string, line string, keep string"
BLANKS = " \t\n\x0b\x0c\r"


def made(seed=3):
    rng = random.Random(seed)
    long = [f"{'Line É number'} {k} {'x' * 40}" for k in range(30)]
    edge = ["y" * 39, "y" * 40, "é" * 40, " \t" + "z" * 40 + "\r", "Z" * 40 + "\x0b", "a" * 20 + " " * 30, "n\0" * 30]
    texts = [rng.choice(["\n", "\r\n"]).join(rng.choice(long + edge + ["", "short"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n" + long[0], "\n".join([long[1]] * 50), "\n".join(long[k % 30] + " " * (k % 3) for k in range(5000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{i} own\nA HOT line that very many documents hold, here and there\nend {i}") for i in range(120)]
    rows += [rows[4], rows[4], (7, long[5]), (None, long[6]), (None, None), (300, "\n".join(long)), (-5, "\n".join(long[:3]))]
    return [r + ("x",) * 5 for r in rows]


def plain(rows, least=40, copies=5):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(BLANKS).translate(fold)
    held = defaultdict(set)
    for doc, text, *_ in rows:
        if doc is not None:
            for x in (text or "").split("\n"):
                if len(key(x)) >= least:
                    held[key(x)].add(doc)
    out = Counter()
    for doc, text, *_ in rows:
        cut = (text or "").split("\n")
        kept = [x for x in cut if doc is None or len(held.get(key(x), ())) < copies or doc == max(held[key(x)])]
        out[(doc, len(cut), len(cut) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_equals_plain(spark, parts):
    rows = made()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = linededup.without_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(map(tuple, got)) == plain(rows)


def test_empty_and_other_settings(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert linededup.without_lines(none).collect() == [] == linededup.keep_bitmaps(none).collect()
    rows = [(i, "ab\nAB \ncd", None, None, None, None, None) for i in range(2)]
    got = linededup.without_lines(spark.createDataFrame(rows, SCHEMA), least=2, copies=2)
    assert Counter(map(tuple, got.collect())) == plain(rows, 2, 2) == Counter([(0, 3, 3, ""), (1, 3, 0, "ab\nAB \ncd")])


def test_stream_settles_the_same_for_any_cut():
    """Partitions and batches may cut a sorted run anywhere."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        rows = np.zeros((n, 6), np.int64)
        rows[:, 0], rows[:, 2], rows[:, 4] = rng.integers(0, 4, n), rng.integers(0, 9, n), np.arange(n)
        rows = rows[np.lexsort((rows[:, 4], -rows[:, 2], rows[:, 0]))]
        held = {h: {int(d) for d in rows[rows[:, 0] == h, 2]} for h in range(4)}
        want = {int(r[4]) for r in rows if len(held[int(r[0])]) >= 5 and r[2] != max(held[int(r[0])])}
        cuts = np.sort(rng.integers(0, n + 1, 3))
        drop, edge, pieces = set(), [], defaultdict(list)
        for task, part in enumerate(np.split(rows, cuts)):
            stream, out = linededup.Stream(task, 5), []
            for batch in np.array_split(part, 3):
                if len(batch):
                    out += stream.feed(batch)
            out += stream.end()
            for b in (x for o in out for x in o.to_pylist()):
                if b["kind"] == "drop":
                    drop.add(b["line"])
                elif b["kind"] == "edge":
                    edge.append((b["h1"], b["doc"], b["line"]))
                else:
                    pieces[b["h1"]].append((b["top"], b["low"], b["docs"]))
        for h, found in pieces.items():
            total = sum(d for *_, d in found) - sum(a[1] == b[0] for a, b in zip(found, found[1:]))
            if total >= 5:
                drop |= {line for g, doc, line in edge if g == h and doc != found[0][0]}
        assert drop == want
