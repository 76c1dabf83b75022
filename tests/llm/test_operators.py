"""Operators against plain versions, on texts with nulls, blanks, ties, repeats, one very long text."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from vigilake.llm import chat, fmindex, maxent, mixing, quality, rounds, shards, simhash, suffixes, tokencount, windows

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, chunk string, fp string,"
          " shard string, score string, n_words string, size string")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def made():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = say(80)
    texts = [say(rng.randint(5, 200)) for _ in range(40)]
    texts += [f"{say(9)} {shared} {say(30)}" for _ in range(6)] + [texts[0]] * 5
    near = texts[1].split()
    texts += [" ".join(near[:-1] + ["zz"]), "One\nOne\nTwo | # words\n", "<s> a\\b [INST] \t x", "", " \n\t ", "é" * 70, "a" * 400, say(20_000), None]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, ""]), None) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], None, None, None), (2, texts[5], "en", "a", 1), (None, None, None, None, None)]
    return [r + ("x",) * 7 for r in rows]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_chunks(monkeypatch):
    for module in (windows, suffixes):
        monkeypatch.setattr(module, "chunked", lambda d, i, t: rounds.chunked(d, i, t, 20_000))


def words(text):
    return (text or "").encode().split()


def without(items, width, first_of, own):
    gone = [False] * len(items)
    for k in range(len(items) - width + 1):
        if own is not None and first_of.get(tuple(items[k:k + width]), own) < own:
            gone[k:k + width] = [True] * width
    return gone


def firsts(split, width):
    found = {}
    for row in ROWS:
        if row[0] is not None:
            items = split(row[1])
            for k in range(len(items) - width + 1):
                key = tuple(items[k:k + width])
                found[key] = min(found.get(key, row[0]), row[0])
    return found


def test_windows(docs, empty, small_chunks):
    first, want = firsts(words, 50), Counter()
    for row in ROWS:
        w = words(row[1])
        gone = without(w, 50, first, row[0])
        want[(row[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    out = windows.without_repeats(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == want
    assert windows.without_repeats(empty).collect() == []


def test_suffixes(docs, empty, small_chunks):
    split = lambda t: list((t or "").encode())
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 20_000]
    first, want = firsts(lambda t: split(t), 50), Counter()
    for row in rows:
        b = split(row[1])
        gone = without(b, 50, first, row[0])
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want[(row[0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs).collect() if r.n_bytes < 30_000)
    assert got == want
    assert suffixes.without_repeats(empty).collect() == []


def test_interval_tree_has_every_level():
    assert sorted(suffixes.intervals([-1, 3, 5, 5, 3, -1, 2])) == [(0, 4, 3, -1), (1, 3, 5, 3), (5, 6, 2, -1)]


def test_simhash(docs, empty):
    def fingerprint(text):
        w = (text or "").encode().translate(LOWER).split()
        s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(r[1]) for r in ROWS]
    label = list(range(len(ROWS)))
    for _ in range(len(ROWS)):
        label = [min(label[j] for j in range(len(ROWS)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(ROWS))]
    lowest = {c: min((r[0] for r, d in zip(ROWS, label) if d == c and r[0] is not None), default=None) for c in label}
    want = Counter((r[0], f, lowest[c]) for r, f, c in zip(ROWS, fps, label))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).collect() == []


def test_one_row_per_class(spark, docs, empty):
    fps = [simhash.fingerprint(r[1], 3) for r in ROWS]
    label = list(range(len(ROWS)))
    for _ in range(len(ROWS)):
        label = [min(label[j] for j in range(len(ROWS)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(ROWS))]

    def first(mine):
        return min(mine, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))

    want = [first([r for r, d in zip(ROWS, label) if d == c]) for c in set(label)]
    kept = simhash.without_near_duplicates(docs.withColumnsRenamed({"row": "row_key", "chunk": "ROW_STATE"}))
    assert kept.columns == [{"row": "row_key", "chunk": "ROW_STATE"}.get(c, c) for c in docs.columns]
    assert Counter((r.doc_id, r.text or "", r.row_key) for r in kept.collect()) == Counter((r[0], r[1] or "", "x") for r in want)
    assert simhash.without_near_duplicates(empty).collect() == []


@pytest.mark.parametrize(("width", "distance"), [(1, 2), (8, 40)])
def test_gray_index_finds_all_links(width, distance):
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2 ** 63, (60, width), dtype=np.uint64)
    for _ in range(3):  # variants of variants, so that classes are chains
        flip = np.uint64(1) << rng.integers(0, 63, (len(fp), width), dtype=np.uint64)
        fp = np.concatenate([fp, fp ^ flip])
    fp = np.unique(fp, axis=0)
    fp = fp[rng.permutation(len(fp))]
    group = np.repeat([0, 1], [len(fp) // 2, len(fp) - len(fp) // 2])
    order = simhash.gray_order(fp, group)
    fp = fp[order]
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]).sum(axis=2) <= distance
    near &= group[:, None] == group[None, :]
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        label = np.array([label[near[i]].min() for i in range(len(fp))])
    for skip in (False, True):
        classes = simhash.Classes(len(fp))
        index = simhash.GrayIndex(fp, group)
        for a, b in index.links(fp, group, distance, block=64, label=classes.label if skip else None):
            classes.add(a, b)
        assert (classes.label == label).all()


def test_gray_rank_is_a_gray_code():
    ranks = simhash.gray_rank(np.stack([np.repeat(np.arange(16), 16), np.tile(np.arange(16), 16)], axis=1).astype(np.uint64))
    assert len({tuple(r) for r in ranks}) == 256
    # next in the code: one bit more or less
    code = np.arange(1 << 12, dtype=np.uint64)
    code ^= code >> np.uint64(1)
    assert (simhash.gray_rank(code[:, None])[:, 0] == np.arange(1 << 12)).all()


def test_components_settle_on_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {(r.u, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


ITEMS = [("i1", "{0} {1} {2} {3} {4} {5} {6} {7} {8} {9} {10} {11}"), ("i2", "Two words"), ("i3", None), (None, "One"), ("i4", ""), ("i1", "One")]


def test_decontamination(spark, docs, empty, monkeypatch):
    sample = words(ROWS[6][1])[:12]
    items = [(i, t and t.format(*[w.decode() for w in sample])) for i, t in ITEMS]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, doc_id string")
    wins = {}
    for item, text in items:
        w = fmindex.split_words(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k:k + 10]), set()).update({item} - {None})
    want = Counter()
    for row in ROWS:
        w, hit, found = fmindex.split_words(row[1]), set(), set()
        for win, owners in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= owners
        want[(row[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    got = lambda: Counter(tuple(r) for r in fmindex.hits(docs, bench).collect())
    assert got() == want
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 40)  # several blocks of test items, the same result
    assert got() == want
    assert fmindex.hits(empty, bench).collect() == []
    assert not any(r.contaminated for r in fmindex.hits(docs, bench.limit(0)).collect())
    one = fmindex.without_spans(docs, bench)
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 10 ** 9)
    clean = fmindex.without_spans(docs.withColumnsRenamed({"row": "__spans", "chunk": "__found"}), bench).withColumnsRenamed({"__spans": "row", "__found": "chunk"})
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, clean.collect()))
    assert clean.columns == docs.columns and not any(r.contaminated for r in fmindex.hits(clean, bench.where("item_id = 'i1' AND text <> 'One'")).collect())
    covered = sum(n for (_, size, hit, *_), n in want.items() if size and hit == size)  # rows without a word left go
    assert clean.count() == len(ROWS) - covered


def test_token_counts(docs, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in ROWS)
    assert Counter(tuple(r) for r in tokencount.token_counts(docs, path, remembered=50).collect()) == want
    assert tokencount.token_counts(empty, path).collect() == []
    merges, rng = tokencount.Merges(path), random.Random(1)
    odd = ["=" * 5000, " " * 3000 + "x", "ab" * 2000, "\x00▁ <0x0A>", "日本語" * 40]
    odd += ["".join(rng.choice("abcthe ing\n▁.=-1é日") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    for text in odd:
        assert sum(merges.counts(merges.pretokens(text))) == len(model.encode(text))


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int("|" not in (r[1] or "")), "x") for i, r in enumerate(ROWS)] + [(None, 0, "x")], "doc_id long, quality int, text string")
    want = Counter()
    for row in ROWS:
        text = row[1] or ""
        w = words(text)
        lines = [x for x in text.split("\n") if x.encode().split()]
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        want[(row[0], len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed)] += 1
    out = quality.judged(docs, labels, trees=10, psi=32).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)
    assert all(r.kept != r.base_failed for r in quality.judged(docs, None, trees=4).collect())
    kept = quality.kept_documents(docs, labels, trees=10, psi=32)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert quality.judged(empty, labels).collect() == []


def test_forest_sets_odd_rows_apart():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(500, 10)), np.full((5, 10), 9.0)])
    trees = [quality.grow(x[rng.choice(len(x), 256, replace=False)], i) for i in range(40)]
    score = quality.Forest(trees, 256, list(range(10))).score(x)
    assert score[-5:].min() > np.quantile(score[:500], 0.99)


def test_language_model(docs, empty):
    split = lambda t: (t or "").encode().translate(LOWER).split() + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in ROWS if not held(r[0]) for w in split(r[1]))
    total = sum(counts.values())
    want = Counter()
    for r in ROWS:
        w = split(r[1])
        base = sum(np.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)
        want[(r[0], held(r[0]), len(w), sum(x in counts for x in w), total, round(base, 4))] += 1
    out = maxent.scored(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert maxent.scored(empty).collect() == []


def test_language_model_sums_to_one():
    rng = np.random.default_rng(4)
    words = [(f"w{n}", int(5000 / (n + 1)) + 1, "xyz"[n % 3]) for n in range(900)] + [("", 300, "x")]
    v = maxent.Vocabulary(words, sum(c for _, c, _ in words) + 50, 1000)
    model = maxent.Model(v, rng.integers(0, 4, (maxent.FEATURES << v.bits, maxent.FAN)) * (rng.random((maxent.FEATURES << v.bits, 1)) < 0.3))
    # every leaf after the same two words
    code = np.concatenate([[7, 8, x] for x in [*range(900), 900 + maxent.SUFFIXES + 1, 900]]).astype(np.int64)
    logs = np.zeros(902)
    for use, node, child, rows in maxent.steps(v, code, np.arange(2, len(code), 3)):
        p = model.probabilities(v, node, rows)
        assert np.allclose(p.sum(1), 1, atol=1e-4)
        logs[use] += np.log(p[np.arange(len(p)), child])
    assert abs(np.exp(logs).sum() - 1) < 1e-3 and len(v.node) > 2


def test_language_model_equals_plain(spark):
    rng = random.Random(12)
    say = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))
    rows = [(i, say(), rng.choice(["en", "de"])) for i in range(150)] + [(3, None, "en"), (None, "a b b", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {}
    for parts in (1, 16):
        got[parts] = sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in maxent.scored(frame.repartition(parts)).collect())
    assert got[1] == got[16]
    slice_of = [r.part for r in frame.selectExpr(f"pmod(xxhash64(doc_id, length(text)), {maxent.SLICES}) as part").collect()]
    split = lambda t: (t or "").encode().split() + [b""]
    train = [(r, p) for r, p in zip(rows, slice_of) if not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2)]
    count, group = Counter(), {}
    for r, _ in train:
        count.update((w, r[2] or "") for w in split(r[1]))
    whole = Counter()
    for (w, _), n in count.items():
        whole[w] += n
    for w in whole:
        group[w] = max((n, g) for (x, g), n in count.items() if x == w)[1]
    v = maxent.Vocabulary([(w.decode(), n, group[w]) for w, n in whole.items()], sum(whole.values()), len(whole))
    n = len(v.code)

    def path(words):
        """(class, child, rows) of every step of every token."""
        code = np.array([n + maxent.SUFFIXES] * 2 + [v.code.get(w, n + int.from_bytes(w[-3:], "little") * 40503 % 65521 % maxent.SUFFIXES) for w in words[:-1]]
                        + [n + maxent.SUFFIXES + 1], np.int64)
        for i in range(2, len(code)):
            leaf = int(v.leaves(code[i:i + 1])[0])
            for depth in range(len(v.node)):
                if (node := int(v.node[depth, leaf])) >= 0:
                    yield node, int(v.child[depth, leaf]), [int(r[0]) for r in v.rows(code, np.array([i]), np.array([node]))]

    seen = {}
    for r, p in train:
        if p > 0:
            for _, child, at in path(split(r[1])):
                for x in at:
                    seen.setdefault(x, Counter())[child] += 1
    moved = {}

    def softmax(node, at):
        logits, left = [0.0] * maxent.FAN, 1.0
        for x in at:
            c = seen.get(x, Counter())
            m = sum(c.values())
            part = maxent.SCALE[x >> v.bits] * m / (m + maxent.HALF)
            left -= part
            for k in range(maxent.FAN):
                logits[k] += part * math.log((c[k] + maxent.EXTRA) / (m + maxent.FAN * maxent.EXTRA)) + moved.get(x, {}).get(k, 0.0)
        e = [math.exp(x + left * float(s)) for x, s in zip(logits, v.shares[node])]
        return [x / sum(e) for x in e]

    gradient, met = {}, Counter()
    for r, p in train:
        if p == 0:
            for node, child, at in path(split(r[1])):
                q = softmax(node, at)
                for x in at:
                    met[x] += 1
                    for k in range(maxent.FAN):
                        gradient.setdefault(x, Counter())[k] += (k == child) - q[k]
    moved = {x: {k: maxent.STEP * g / (met[x] + maxent.DAMP) for k, g in c.items()} for x, c in gradient.items()}
    assert moved
    want = []
    for r in rows:
        words = split(r[1])
        score = sum(math.log10(softmax(node, at)[child]) for node, child, at in path(words))
        score -= sum(w not in whole for w in words) * math.log10(v.tail_total + v.tail_kinds + 1)
        want.append((-1 if r[0] is None else r[0] or -1, len(words), score))
    for (i, m, score), (j, k, plain) in zip(got[1], sorted(want, key=lambda x: (x[0], x[1], x[2]))):
        assert (i, m) == (j, k) and abs(score - plain) < 1e-3 * max(1, abs(plain))


def test_held_out_text_gains(spark):
    rng = random.Random(3)
    tongues = [[f"{p}{i}" for i in range(80)] for p in "pqr"]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(60)), "abc"[i % 3]) for i in range(400)]
    out = [r for r in maxent.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.held_out]
    assert len(out) > 30 and sum(r.score for r in out) > 0.93 * sum(r.base_score for r in out)


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs, keep=0.5, power=0.5, sweeps=16).collect()
    assert len(out) == len(ROWS)
    tokens = Counter((r["__source"], r["__lang"], r["__topic"]) for r in out)
    assert sum(tokens.values()) == len(ROWS) and all(0 <= r["__rate"] <= 1 for r in out)
    assert all(r["__tokens"] == len(words(r.text)) and (r["__tokens"] or not r["__drawn"]) for r in out)
    # what is expected to be drawn of each key: its tokens to a power, all of them at most
    for d in ("source", "lang", "topic"):
        has, drawn = Counter(), Counter()
        for r in out:
            has[r[f"__{d}"]] += r["__tokens"]
            drawn[r[f"__{d}"]] += r["__tokens"] * r["__rate"]
        has = {k: n for k, n in has.items() if n}
        low, high = 0.0, float(sum(has.values()))
        for _ in range(200):
            m = (low + high) / 2
            low, high = (low, m) if sum(min(n, m * n ** 0.5) for n in has.values()) > sum(has.values()) / 2 else (m, high)
        for k, n in has.items():
            miss = max((r["__off"] for r in out if r[f"__{d}"] == k and r["__tokens"]), default=0)
            assert abs(drawn[k] / min(n, low * n ** 0.5) - 1) <= miss + 1e-6
    cells = spark.createDataFrame([("a", "en", "p", 100), ("a", "de", "q", 50), ("b", "en", "q", 30), ("b", "de", "p", 20), ("c", "en", "p", 9)],
                                  "source string, lang string, topic string, tokens long")

    def raked(keep, **shares):
        tables = {d: spark.createDataFrame([(k, s) for k, s in t.items()], f"{d} string, share double") for d, t in shares.items()}
        return mixing.rake(cells, mixing.given(cells, tables, keep), sweeps=24).collect()

    # b can give 50 of 209 tokens and should be 0.4 of what is drawn: 125 at most, not half of all but a quarter
    wanted = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"p": 0.5, "q": 0.5}}
    for keep, budget in ((0.25, 209 / 4), (0.9, 125)):
        found = raked(keep, **wanted)
        assert all(r.drawn <= r.tokens + 1e-9 for r in found) and not any(r.source == "c" for r in found)
        for d, t in wanted.items():
            for key, share in t.items():
                got = sum(r.drawn for r in found if r[d] == key)
                miss = max(r.off for r in found if r[d] == key)
                assert abs(got / (share * budget) - 1) <= miss + 1e-9 and (keep > 0.25 or miss < 1e-6)
    drawn = mixing.drawn_rows(docs.withColumnsRenamed({"row": "__tokens", "chunk": "__rate"}), keep=0.5, power=0.5, sweeps=16)
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in out if r["__drawn"])
    assert mixing.drawn_rows(empty).collect() == []
    assert mixing.mix(empty).collect() == []


def test_shards(docs, empty):
    out = shards.shards(docs, n_shards=4, carry=("text", "size", "lang")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    total = sum(r.size for r in out)
    order = sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32))
    assert [r.shard for r in order] == sorted(r.shard for r in out)
    at = 0
    for r in order:
        assert r.shard == (2 * at + r.size) * 4 // (2 * total)
        at += r.size
    for k in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert shards.shards(empty).collect() == []


def test_chat(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|turn|>"]), rng.choice(["</s>[INST] ok", "\\\\l<\\b[", "", None, "x<|end|>y", "é\n"]), "z")
            for c in [1, 2, None] for t in [0, 1, 1, 5, 300, None]] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.formatted(frame, block=2)
    for r in chat.read_back(done).collect():
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(t[2], t[3]) for t in turns]
        assert r.loss_texts == [t[3] for t in turns if t[2] == "assistant"]
    assert chat.formatted(frame.limit(0)).collect() == []
    records = [(1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","extra":1}],"id":7}'),
               (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'), (3, '{"prompt":"a","completion":"b"}'),
               (4, '{"instruction":"a","input":"c","output":"b"}'), (5, '{"data":{"question":"a","answer":"b"}}'), (6, "{"), (7, None), (8, '{"other":1}')]
    out = {}
    for r in chat.canonical(spark.createDataFrame(records, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    assert out[1] == out[2] == out[3] == out[5] == [("user", "a"), ("assistant", "b")]
    assert out[4] == [("user", "a\n\nc"), ("assistant", "b")]
    assert out[6] == out[7] == out[8] == [(None, None)]
