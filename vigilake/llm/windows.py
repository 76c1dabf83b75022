"""Substring dedup on words by Rabin-Karp window hashes (operator 9).

Every run of ``width`` words has a rolling hash. Spark counts in how many chunks each hash
occurs; hashes that occur once are done. For the rest a second, independent hash joins the
first to 128 bits, and the lowest document of each is found. Windows with an earlier
document merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import BLANKS
from .rounds import LATEST, answer, ask, chunked, dealt, marked_bits, mixed, received, seen_twice, sent, several, short, slices

ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
#: Odd multipliers of the two hashes: (bytes of a word, words of a window).
BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Powers:
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def runs_of(values: np.ndarray, first: np.ndarray, last: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[first:last] for each pair, from one prefix sum."""
    up, down = powers.upto(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


class Hasher:
    def __init__(self, which: int):
        self.letters, self.words = (Powers(b) for b in BASES[which])
        self.plus = np.uint64(1 + which)

    def windows(self, raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, first word) of all windows, and the words per document."""
        keys, docs, firsts, sizes = [], [], [], []
        for begin, end in slices(raws):
            buf = np.frombuffer(b"\n".join([*raws[begin:end], b""]), np.uint8)
            blank = _BLANK[buf]
            edge = np.flatnonzero(np.diff(blank, prepend=True))
            start, stop = edge[::2], edge[1::2]
            bounds = np.cumsum([len(r) + 1 for r in raws[begin:end]])
            doc = np.searchsorted(bounds, start, side="right")
            size = np.bincount(doc, minlength=end - begin)
            sizes.append(size)
            if len(start) < width:
                continue
            word = runs_of(buf.astype(np.uint64) + self.plus, start, stop, self.letters)
            at = np.flatnonzero(doc[:len(doc) - width + 1] == doc[width - 1:])
            keys.append(runs_of(word, at, at + width, self.words))
            docs.append(doc[at] + begin)
            firsts.append(at - (np.cumsum(size) - size)[doc[at]])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join(keys, np.uint64), join(docs, np.int64), join(firsts, np.int64), join(sizes, np.int64)


def _lowest(payloads: list[bytes]) -> list[bytes]:
    """Lowest document of each 128-bit key, in the order of the entries."""
    sizes = [len(p) // ENTRY.itemsize for p in payloads]
    e = np.frombuffer(b"".join(payloads), ENTRY)
    order = np.lexsort((e["doc"], e["b"], e["a"]))
    a, b = e["a"][order], e["b"][order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    low = np.empty(len(e), "<i8")
    low[order] = e["doc"][order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return [x.tobytes() for x in np.split(low, np.cumsum(sizes)[:-1])]


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a blank) and kept_sha256 per row.

    A word goes if a window that covers it also starts in a row with a smaller id. Null and
    empty texts have no words; texts shorter than a window lose nothing; rows with equal
    ids never remove each other's words; rows without id neither remove nor lose any.
    Windows are judged on the input. Extra columns are ignored; an empty table gives no rows.
    """
    chunks, n_buckets = chunked(docs, id_col, text_col)

    def read(group: pd.DataFrame):
        group = group.sort_values("doc_id", kind="stable", na_position="last")
        raws = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in group["text"]]
        ids = group["doc_id"].astype("Int64")
        known = ids.notna().to_numpy()
        number = ids.fillna(LATEST).astype(np.int64).to_numpy()
        key, doc, first, sizes = Hasher(0).windows(raws, width)
        use = known[doc]
        key, doc, first = key[use], doc[use], first[use]
        unique, place, low, multi = several(key, number[doc])
        return group, raws, number, doc, first, sizes, unique, place, low, multi, dealt(unique, n_buckets)

    def keys(chunk: int, group: pd.DataFrame, _):
        *_, unique, _, _, _, (order, bounds) = read(group)
        return sent(chunk, order, bounds, lambda at: short(unique[at]))

    def repeated(told, unique, multi, order, bounds):
        live = np.flatnonzero(marked_bits(received(told, 1), order, bounds) | multi)
        return live, dealt(unique[live], n_buckets)

    def entries(chunk: int, group: pd.DataFrame, told):
        _, raws, _, doc, first, _, unique, place, low, multi, (order, bounds) = read(group)
        live, (order, bounds) = repeated(told, unique, multi, order, bounds)
        one = np.empty(len(unique), np.int64)
        one[place] = np.arange(len(place))  # some window of each key
        second = Hasher(1).windows(raws, width)[0][:len(place)] if len(live) else np.zeros(0, np.uint64)
        e = np.empty(len(live), ENTRY)
        e["a"], e["b"], e["doc"] = unique[live], second[one[live]], low[live]
        return sent(chunk, order, bounds, lambda at: e[at].tobytes())

    def removal(chunk: int, group: pd.DataFrame, told):
        group, raws, number, doc, first, sizes, unique, place, _, multi, (order, bounds) = read(group)
        live, (order, bounds) = repeated(told, unique, multi, order, bounds)
        earliest = np.full(len(unique), LATEST)
        for b, payload in received(told, 2).items():
            earliest[live[order[bounds[b]:bounds[b + 1]]]] = np.frombuffer(payload, "<i8")
        gone = earliest[place] < number[doc]
        change = np.zeros(int(sizes.sum()) + 1, np.int64)
        at = first[gone] + (np.cumsum(sizes) - sizes)[doc[gone]]
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        covered = np.cumsum(change)[:-1] > 0
        kept, begin, removed = [], 0, []
        for raw, n in zip(raws, sizes.tolist()):
            words, out = raw.split(), covered[begin:begin + n]
            begin += n
            removed.append(int(out.sum()))
            kept.append(b" ".join(words if not removed[-1] else [w for w, o in zip(words, out.tolist()) if not o]))
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64").to_numpy(dtype=object), "n_words": sizes, "n_removed": removed,
                             "kept": [k.decode("utf-8", "surrogatepass") for k in kept],
                             "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}).astype({"doc_id": "Int64"})

    told = answer(ask(chunks, keys), seen_twice, 1)
    told = told.union(answer(ask(chunks, entries, told), _lowest, 2))
    return ask(chunks, removal, told, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
