"""Token counts of a byte-fallback BPE model by rank-synchronous array merging (operator 4).

Texts are cut into pre-tokens at places no piece of the vocabulary spans. The distinct
pre-tokens of a batch become one flat array of symbol ids with sequence numbers. In every
round each sequence merges its lowest-rank pair, all sequences at once, until no sequence
has a pair left; the surviving symbols are the tokens. A fragment of over 2,048 characters is
merged pair by pair with a queue instead, with the same result: long runs of tied pairs would take
a round for every merge. Counts are remembered per task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exactly

SPACE = "▁"
NONE = np.iinfo(np.int64).max


class Merges:
    """Pair table of a model: two symbol ids -> rank and id of the joined piece.

    ``together[piece]``: merging all its occurrences in one round is the same as one after
    the other, since no piece that could follow from it ranks as well or better.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "\ufb01 \uff41  x "  # a ligature, a wide letter, two blanks, one at the end
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models without text normalisation are supported")
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(n, NONE)
        for i in plain:
            self.rank[i] = order[model.get_score(i)]
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        self.n = n
        shared = np.bincount(self.rank[plain]) > 1
        self.together = np.ones(n, bool)
        self.together[plain] = ~shared[self.rank[plain]]
        keys, joined = [], []
        self.bigrams = set()
        for p, i in pieces.items():
            self.bigrams.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(i)
                    for part in (a, b):
                        if self.rank[i] <= self.rank[part]:
                            self.together[part] = False
        at = np.argsort(keys)
        self.keys, self.joined = np.array(keys, np.int64)[at], np.array(joined, np.int64)[at]
        self.pairs = dict(zip(keys, joined))
        inner = any((a, SPACE) in self.bigrams for a in {x for x, _ in self.bigrams} - {SPACE})
        newline = any("\n" in pair for pair in self.bigrams)
        if inner:
            raise ValueError("a piece has a blank after a letter: texts cannot be cut at blanks")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if newline else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall

    def pretokens(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def fragments(self, word: str) -> list[str]:
        """A long pre-token cut wherever no piece holds the two characters side by side."""
        if len(word) < 24:
            return [word]
        cuts = [k for k in range(1, len(word)) if (word[k - 1], word[k]) not in self.bigrams]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        parts, owner = [], []
        for w, word in enumerate(words):
            for f in self.fragments(word):
                parts.append(f)
                owner.append(w)
        lone = {i for i, f in enumerate(parts) if len(f) > 2048}  # one long run of tied pairs would take a round per merge
        total = np.zeros(len(words), np.int64)
        for i in lone:
            total[owner[i]] += self.one_by_one(parts[i])
        rest = [i for i in range(len(parts)) if i not in lone]
        np.add.at(total, np.array([owner[i] for i in rest], np.int64), self.synchronous([parts[i] for i in rest]))
        return total.tolist()

    def symbols(self, text: str) -> list[int]:
        """Piece ids; characters outside the vocabulary are numbered after the pieces."""
        return [self.chars.get(c, self.n + ord(c)) for c in text]

    def weight(self, sym: np.ndarray) -> np.ndarray:
        """Tokens a symbol stands for: one, or its UTF-8 bytes where it is outside the vocabulary."""
        code = sym - self.n
        return np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))

    def synchronous(self, parts: list[str]) -> np.ndarray:
        count = np.zeros(len(parts), np.int64)
        sym = np.array([s for p in parts for s in self.symbols(p)], np.int64)
        seq = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            piece = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.joined[at], -1)
            rank = np.append(np.where(piece >= 0, self.rank[piece], NONE), NONE)
            start = np.flatnonzero(np.diff(seq, prepend=-1))
            best = np.minimum.reduceat(rank, start)
            size = np.diff(start, append=len(seq))
            over = np.repeat(best == NONE, size)
            if over.any():  # finished sequences leave the arrays
                np.add.at(count, seq[over], self.weight(sym[over]))
                live = ~over
                sym, seq, rank = sym[live], seq[live], rank[live]
                piece = np.append(piece, -1)[live]
                start = np.flatnonzero(np.diff(seq, prepend=-1))
                best, size = best[best != NONE], np.diff(start, append=len(seq))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            first = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
            hit = hit[first | self.together[piece[hit]]]
            # neighbours share a symbol: within a run of hits every second one is merged
            fresh = np.append(True, np.diff(hit) > 1)
            run = np.flatnonzero(fresh)
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            hit = hit[nth % 2 == 0]
            sym[hit] = piece[hit]
            alive = np.ones(len(sym), bool)
            alive[hit + 1] = False
            sym, seq = sym[alive], seq[alive]
        return count

    def one_by_one(self, text: str) -> int:
        """The same for one long sequence, with a queue of pairs by rank and place."""
        sym = self.symbols(text)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(sym) and (p := self.pairs.get(sym[a] << 32 | sym[b])) is not None:
                heapq.heappush(queue, (int(self.rank[p]), a, sym[a], sym[b]))

        for a in range(len(sym) - 1):
            offer(a, a + 1)
        while queue:
            _, a, x, y = heapq.heappop(queue)
            b = after[a] if sym[a] == x else len(sym)
            if b >= len(sym) or sym[b] != y:
                continue
            sym[a], sym[b] = self.pairs[x << 32 | y], -1
            after[a] = after[b]
            if after[b] < len(sym):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return int(self.weight(np.array([s for s in sym if s >= 0], np.int64)).sum())


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 remembered: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``.

    ``model`` is the path of a sentencepiece BPE model with byte fallback. Null and empty
    texts have no bytes and no tokens; ids may be null or repeat, and repeated rows count each; other
    columns are ignored; an empty table gives no rows. Very long texts are taken whole. A task
    remembers up to ``remembered`` pre-tokens, of any length, and then starts afresh.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges, seen = Merges(model), {}
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            tokens, begin = [], 0
            while begin < len(texts):  # about 1 MB of text at a time
                end, taken = begin, 0
                while end < len(texts) and (end == begin or taken + sizes[end] <= 1_000_000):
                    taken += sizes[end]
                    end += 1
                cut = [merges.pretokens(t) for t in texts[begin:end]]
                new = list(set().union(*cut).difference(seen))
                seen.update(zip(new, merges.counts(new)))
                tokens += [sum(map(seen.__getitem__, words)) for words in cut]
                if len(seen) > remembered:
                    seen.clear()
                begin = end
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": sizes, "n_tokens": tokens,
                                "over_limit": [n > limit for n in tokens]}).astype({"doc_id": "Int64"})

    return docs.select(exactly(id_col).cast("long").alias("doc_id"), exactly(text_col).cast("string").alias("text")).mapInPandas(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
