"""Substring dedup on bytes by common-prefix interval trees over enhanced suffix arrays (operator 5).

Every ``width``-byte string holds an anchor: the position, within it, of the smallest hash
of ``gram`` bytes. Equal strings have equal anchors, so only suffixes at anchors need to be
sorted. Anchors whose gram occurs in one document alone are done after the first round.
The others go, with the bytes around them, to the bucket of their gram. A bucket sorts the
suffixes at its anchors, scans the common-prefix array with a stack for the interval tree,
tests in each interval whether the bytes to the left differ, and so has every maximal group
of equal strings with all of its occurrences, and its lowest document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .rounds import LATEST, answer, ask, chunked, dealt, marked_bits, mixed, received, seen_twice, sent, several, short, slices

#: gram hash, bytes left of the anchor, number of strings that have this anchor, lowest document
CONTEXT = np.dtype([("gram", "<u8"), ("left", "u1"), ("count", "u1"), ("doc", "<i8")])
RUN = np.dtype([("a", "u1"), ("b", "u1"), ("doc", "<i8")])
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of the ``gram`` bytes from each position on, by doubling."""
    base, out, done = 0xD6E8FEB86659FD93, None, 0
    power, size = _LETTER[buf], 1
    while True:
        if gram & size:
            out = power[:len(buf) - size + 1] if out is None else (
                out[:len(buf) - done - size + 1] * np.uint64(pow(base, size, 1 << 64)) + power[done:len(buf) - size + 1])
            done += size
        if done == gram:
            return mixed(out)
        power = power[:len(power) - size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def anchors(raws: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first string, last string, gram hash): strings by their offsets in the document."""
    out = []
    for begin, end in slices(raws):
        buf = np.frombuffer(b"".join(raws[begin:end]), np.uint8)
        if len(buf) < width:
            continue
        hashes = gram_hashes(buf, gram)
        # the place breaks ties, so the leftmost of equal hashes is the anchor
        packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_least(packed, width - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.array([len(r) for r in raws[begin:end]], np.int64)
        stop = np.cumsum(sizes)
        doc = np.repeat(np.arange(end - begin), sizes)[:len(anchor)]
        at = np.flatnonzero(np.arange(len(anchor)) + width <= stop[doc])
        if not len(at):
            continue
        fresh = np.append(True, (np.diff(anchor[at]) != 0) | (np.diff(at) != 1))
        first = at[fresh]
        last = at[np.append(np.flatnonzero(fresh)[1:], len(at)) - 1]
        d, a = doc[first], anchor[first]
        origin = (stop - sizes)[d]
        out.append((d + begin, a - origin, first - origin, last - origin, hashes[a]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def intervals(lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """Stack scan: (first, last, common prefix, that of the parent) of every interval of the tree.

    ``lcp[i]`` stands between rows i - 1 and i; -1 where nothing is shared.
    """
    found, stack, n = [], [], len(lcp)
    for i in range(1, n + 1):
        now, first = lcp[i] if i < n else -1, i - 1
        while stack and stack[-1][0] > now:
            prefix, first = stack.pop()
            found.append((first, i - 1, prefix, max(now, stack[-1][0] if stack else -1)))
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return found


def padded(buf: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on (backwards with step -1), zero after ``size``."""
    at = np.arange(width)
    rows = buf[np.clip(start[:, None] + step * at, 0, max(0, len(buf) - 1))]
    rows[at[None, :] >= size[:, None]] = 0
    return rows


def ordered(rows: np.ndarray, *before: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Lexicographic order of byte rows, after other keys; of rows that differ only in the zeros
    they end with, padding included, the shorter comes first."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    words = wide.view(">u8")
    last = [] if size is None else [size]
    return np.lexsort(last + [words[:, i] for i in range(words.shape[1] - 1, -1, -1)] + list(before[::-1]))


def common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.append(0, np.minimum(prefix, np.minimum(size[1:], size[:-1])))


def lowest_documents(gram, left, count, doc, buf, start, width: int, gram_size: int) -> np.ndarray:
    """Per context a row: the lowest document that has the string beginning l bytes left of the anchor.

    Column l is valid where the context has that string.
    """
    reach = width - gram_size + 1
    n = len(gram)
    right_size = count.astype(np.int64) - 1 + width - left
    right = padded(buf, start + left, right_size, width)
    order = ordered(right, gram, size=right_size)
    lcp = common(right[order], right_size[order])
    lcp[np.append(True, gram[order][1:] != gram[order][:-1])] = -1
    lowest = np.repeat(doc[:, None], reach, 1)
    nodes = intervals(lcp.tolist())
    if not nodes:
        return lowest
    # left of the anchor: class of the last l bytes, for every l
    left_rows = padded(buf, start + left - 1, left, reach - 1, -1)
    by_left = ordered(left_rows, gram, size=left)
    lcs = common(left_rows[by_left], left[by_left])
    lcs[np.append(True, gram[by_left][1:] != gram[by_left][:-1])] = -1
    classes = np.empty((n, reach), np.int64)
    for k in range(reach):
        classes[by_left, k] = np.cumsum(lcs < k)
    low, high, prefix, parent = np.array(nodes, np.int64).T
    # strings that begin l bytes left share width - l bytes from the anchor on: each l belongs to one node
    l_from, l_to = np.maximum(0, width - prefix), np.minimum(reach - 1, width - parent - 1)
    some = l_from <= l_to
    low, high, l_from, l_to = low[some], high[some], l_from[some], l_to[some]
    size, span = high - low + 1, l_to - l_from + 1
    node = np.repeat(np.arange(len(low)), size)
    member = order[np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    # same bytes on the left throughout: one class for all l of the node; else one per l and left class
    farthest = classes[member, l_to[node]]
    head = np.cumsum(size) - size
    diverse = np.minimum.reduceat(farthest, head) != np.maximum.reduceat(farthest, head) if len(head) else np.zeros(0, bool)
    many = np.repeat(span[node], 1)
    who = np.repeat(np.arange(len(node)), many)
    l_ = l_from[node][who] + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    has = l_ <= left[member[who]]
    who, l_ = who[has], l_[has]
    key_class = np.where(diverse[node[who]], classes[member[who], l_], 0)
    key = np.stack([node[who], l_, key_class])
    at = np.lexsort(key)
    if not len(at):
        return lowest
    fresh = np.flatnonzero(np.append(True, (np.diff(key[:, at]) != 0).any(0)))
    least = np.minimum.reduceat(doc[member[who[at]]], fresh)
    lowest[member[who[at]], l_[at]] = np.repeat(least, np.diff(np.append(fresh, len(at))))
    return lowest


def pack_contexts(heads: np.ndarray, bodies: list[bytes]) -> bytes:
    return len(heads).to_bytes(8, "little") + heads.tobytes() + b"".join(bodies)


def bucket_reply(payloads: list[bytes], width: int, gram_size: int) -> list[bytes]:
    """Per context the runs of its strings and their lowest documents."""
    heads, texts, sizes = [], [], []
    for p in payloads:
        n = int.from_bytes(p[:8], "little")
        heads.append(np.frombuffer(p, CONTEXT, n, 8))
        texts.append(p[8 + n * CONTEXT.itemsize:])
        sizes.append(n)
    e, buf = np.concatenate(heads), np.frombuffer(b"".join(texts), np.uint8)
    length = e["count"].astype(np.int64) - 1 + width
    start = np.cumsum(length) - length
    left = e["left"].astype(np.int64)
    # equal contexts first: most repeats are settled here
    rows = padded(buf, start, length, int(length.max()))
    order = ordered(rows, e["gram"], left, length)
    equal = np.append(False, (rows[order][1:] == rows[order][:-1]).all(1) & (e["gram"][order][1:] == e["gram"][order][:-1])
                      & (left[order][1:] == left[order][:-1]) & (length[order][1:] == length[order][:-1]))
    head = np.flatnonzero(~equal)
    one = order[head]
    which = np.empty(len(e), np.int64)
    which[order] = np.cumsum(~equal) - 1
    doc = np.minimum.reduceat(e["doc"][order], head)
    lowest = lowest_documents(e["gram"][one], left[one], e["count"][one], doc, buf, start[one], width, gram_size)
    # from offsets left of the anchor to offsets in the context, as runs of one document
    count = e["count"][one].astype(np.int64)
    reach = lowest.shape[1]
    at = np.arange(reach)
    inside = at[None, :] < count[:, None]
    table = np.take_along_axis(lowest, np.clip(left[one][:, None] - at[None, :], 0, reach - 1), 1)
    fresh = inside & np.concatenate([np.ones((len(one), 1), bool), table[:, 1:] != table[:, :-1]], 1)
    row, col = np.nonzero(fresh)
    runs = np.empty(len(row), RUN)
    runs["a"], runs["doc"] = col, table[row, col]
    runs["b"] = np.where(np.append(row[1:] != row[:-1], True), count[row], np.append(col[1:], 0))
    per = np.bincount(row, minlength=len(one))
    begin = np.cumsum(per) - per
    out, at_entry = [], 0
    for n in sizes:
        w = which[at_entry:at_entry + n]
        at_entry += n
        k = per[w]
        pick = np.repeat(begin[w], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out.append(k.astype("u1").tobytes() + runs[pick].tobytes())
    return out


def without_repeats(docs: DataFrame, width: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 per row.

    A byte goes if a ``width``-byte string that covers it also starts in a row with a smaller
    id. Null and empty texts have no bytes; texts shorter than ``width`` lose nothing; rows
    with equal ids never remove each other's bytes; rows without id neither remove nor lose
    any. Strings are judged on the input. Extra columns are ignored; an empty table gives no rows.
    """
    chunks, n_buckets = chunked(docs, id_col, text_col)

    def read(group: pd.DataFrame):
        group = group.sort_values("doc_id", kind="stable", na_position="last")
        raws = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in group["text"]]
        ids = group["doc_id"].astype("Int64")
        number = ids.fillna(LATEST).astype(np.int64).to_numpy()
        doc, anchor, first, last, key = anchors(raws, width, gram)
        use = ids.notna().to_numpy()[doc]
        doc, anchor, first, last, key = doc[use], anchor[use], first[use], last[use], key[use]
        unique, place, _, multi = several(key, number[doc])
        return group, raws, number, (doc, anchor, first, last), unique, place, multi, dealt(unique, n_buckets)

    def keys(chunk: int, group: pd.DataFrame, _):
        *_, unique, _, _, (order, bounds) = read(group)
        return sent(chunk, order, bounds, lambda at: short(unique[at]))

    def contexts(told, group: pd.DataFrame):
        """Distinct contexts of the anchors that occur elsewhere, and which one each such anchor has."""
        group, raws, number, spots, unique, place, multi, (order, bounds) = read(group)
        live = (marked_bits(received(told, 1), order, bounds) | multi)[place]
        doc, anchor, first, last = (x[live] for x in spots)
        known: dict[tuple, int] = {}
        heads, bodies, which = [], [], []
        for g, d, a, f, t in zip(unique[place[live]].tolist(), doc.tolist(), anchor.tolist(), first.tolist(), last.tolist()):
            body = raws[d][f:t + width]
            key = (g, a - f, body)
            at = known.get(key)
            if at is None:  # documents come in order of their ids: the first is the lowest
                at = known[key] = len(heads)
                heads.append((g, a - f, t - f + 1, int(number[d])))
                bodies.append(body)
            which.append(at)
        heads = np.array(heads, CONTEXT) if heads else np.zeros(0, CONTEXT)
        return group, raws, number, doc, first, heads, bodies, np.array(which, np.int64), dealt(heads["gram"], n_buckets)

    def entries(chunk: int, group: pd.DataFrame, told):
        *_, heads, bodies, _, (order, bounds) = contexts(told, group)
        return sent(chunk, order, bounds, lambda at: pack_contexts(heads[at], [bodies[i] for i in at.tolist()]))

    def removal(chunk: int, group: pd.DataFrame, told):
        group, raws, number, doc, first, heads, _, which, (order, bounds) = contexts(told, group)
        sizes = np.array([len(r) for r in raws], np.int64)
        origin = np.cumsum(sizes) - sizes
        per, parts, begin = np.zeros(len(heads), np.int64), [], np.zeros(len(heads), np.int64)
        filled = 0
        for b, payload in sorted(received(told, 2).items()):
            entry = order[bounds[b]:bounds[b + 1]]
            k = np.frombuffer(payload, "u1", len(entry)).astype(np.int64)
            per[entry], begin[entry] = k, filled + np.cumsum(k) - k
            parts.append(np.frombuffer(payload, RUN, int(k.sum()), len(entry)))
            filled += int(k.sum())
        runs = np.concatenate(parts) if parts else np.zeros(0, RUN)
        k = per[which]
        run = runs[np.repeat(begin[which], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        spot = np.repeat(np.arange(len(which)), k)
        gone = run["doc"] < number[doc[spot]]
        at = origin[doc[spot[gone]]] + first[spot[gone]]
        change = np.zeros(int(sizes.sum()) + 1, np.int32)
        np.add.at(change, at + run["a"][gone], 1)
        np.add.at(change, at + run["b"][gone].astype(np.int64) - 1 + width, -1)
        covered = np.cumsum(change)[:-1] > 0
        removed, spans, kept = [], [], []
        for o, n, raw in zip(origin.tolist(), sizes.tolist(), raws):
            c = covered[o:o + n]
            removed.append(int(c.sum()))
            spans.append(int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if n and removed[-1] else 0)
            kept.append(np.frombuffer(raw, np.uint8)[~c].tobytes() if removed[-1] else raw)
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64").to_numpy(dtype=object), "n_bytes": sizes, "n_removed": removed, "n_spans": spans,
                             "kept": kept, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}).astype({"doc_id": "Int64"})

    told = answer(ask(chunks, keys), seen_twice, 1)
    told = told.union(answer(ask(chunks, entries, told), lambda p: bucket_reply(p, width, gram), 2))
    return ask(chunks, removal, told, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
