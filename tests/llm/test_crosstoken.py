"""Alignment of two tokenizers against a plain version: every link, every count."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vigilake.llm import crosstoken

public = pytest.importorskip("public_tokenizers")
PATHS = [public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")]
SCHEMA = "doc_id long, text string, chunk string, radix string, owner string, groups string"


def made():
    rng = random.Random(5)
    words = ["alpha", "naïve", "Straße", "日本語", "x1", "don't", "🙂", "tokenization", "I'll", "<s>", "<|endoftext|>", "--", "1234567"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t ", ""]) for _ in range(n))
    texts = [say(rng.randint(1, 60)) for _ in range(60)] + ["the same common words"] * 40
    texts += [None, "", " ", "  x", "a\0b", "▁ under", "\r\n\r\n", "é" * 90, "a" * 3000, "ﬁ ligature", "é", "</s>", " ", say(4000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r + ("x",) * 4 for r in rows + [rows[3], (None, texts[4]), (2, texts[5]), (None, None)]]


def plain(rows):
    a, b = crosstoken.Bytewise(PATHS[0]), crosstoken.Pieces(PATHS[1])
    per_row, count = [], Counter()
    for doc, text, *_ in rows:
        x = a.model.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.model.encode(text) if text else []
        if not text or b"".join(a.bytes[i] for i in x) != (" " + text).encode() or b"".join(b.bytes[i] for i in y) != (" " + text).encode():
            per_row.append((doc, [], [], [], []))
            continue
        def ends(ids, table):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append(at)
            return out
        ea, eb = ends(x, a.bytes), ends(y, b.bytes)
        common = sorted(set(ea) & set(eb))
        at_a, at_b = dict(zip(ea, x)), dict(zip(eb, y))
        links = [(at_a[p], at_b[p]) for p in common]
        groups, i, j = [], 0, 0
        for hi in common:
            gi, gj = [], []
            while i < len(x) and ea[i] <= hi:
                gi.append(x[i])
                i += 1
            while j < len(y) and eb[j] <= hi:
                gj.append(y[j])
                j += 1
            groups.append((gi, gj))
        per_row.append((doc, x, y, groups, links))
        count.update(links)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    out = Counter()
    for doc, x, y, groups, links in per_row:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out[(doc, len(x), len(y), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(said.encode()).hexdigest() if x else "")] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain(spark, monkeypatch, small):
    rows = made()
    if small:
        monkeypatch.setattr(crosstoken, "WIDTH", 2)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7 if small else 3)
    got = crosstoken.alignment(frame, *PATHS).collect()
    assert Counter(map(tuple, got)) == plain(rows)
    assert sum(r.n_a > 0 for r in got) > 60


def test_empty(spark):
    assert crosstoken.alignment(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []


def test_parts_change_no_token(monkeypatch):
    a, b = crosstoken.Tables(crosstoken.Bytewise(PATHS[0]), ",", "|"), crosstoken.Tables(crosstoken.Pieces(PATHS[1]), ",", ";")
    assert a.tokenizer.cuts and b.tokenizer.cuts
    texts = [r[1] for r in made()]
    whole = crosstoken.measured(texts, a, b)
    monkeypatch.setattr(crosstoken, "SEGMENT", 7)
    cut = crosstoken.measured(texts, a, b)
    assert cut[1] == whole[1] and all(np.array_equal(cut[k], whole[k]) for k in (0, 2, 3))


def test_ranks_merge_like_the_list():
    """The faster library gives the ids of the file's own, on any bytes and letters."""
    a, rng = crosstoken.Bytewise(PATHS[0]), random.Random(6)
    assert a.fast is not None
    letters = [chr(c) for c in [*range(0x250), *range(0x400, 0x460), 0x3042, 0x30AB, 0x4E00, 0x65E5, 0x2014, 0x20AC]] + ["'", "'ll", "the", "ing", " ", " ", "  ", "\n", "1", "://"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(5000)] + ["a" * 5000, " " * 700 + "x", "\r\n" * 50]
    fast = a.encode(texts)
    a.fast = None
    assert fast == a.encode(texts)


def test_packed_round_trip():
    arrays = [np.array([], np.int64), np.array([-5, 2 ** 62, 0, 7]), np.arange(1000)]
    assert all(np.array_equal(x, y) for x, y in zip(crosstoken.unpacked(crosstoken.packed(*arrays)), arrays))


def test_heap_merge_equals_counting():
    rng = np.random.default_rng(2)
    frames, want = [], Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 50, 20))
        n = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), n.tolist())))
        frames.append(crosstoken.packed(np.diff(keys, prepend=0), n))
    keys, totals = crosstoken.merged(frames)
    assert list(zip(keys.tolist(), totals.tolist())) == sorted(want.items())
