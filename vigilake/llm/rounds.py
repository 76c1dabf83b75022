"""Question rounds between chunks of documents and buckets of keys.

Repeats across all documents are found without shuffling a row per position. Documents lie
in chunks of bounded size. In a round every chunk sends one binary block per bucket, with
its own repeats already counted; a bucket compares the blocks of all chunks and answers
each. One exchange holds the chunks and is used again in every round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exactly, partitions

BLOCK = "bucket int, chunk int, round int, payload binary"
CHUNK_BYTES = 8_000_000
SLICE_BYTES = 1_000_000
LATEST = np.iinfo(np.int64).max


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, chunk), dealt out by chunk; and the number of chunks.

    Chunks follow from the place of a row in the input, so copies and equal ids spread evenly.
    """
    total = docs.select(F.octet_length(exactly(text_col)).alias("n")).agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    rows = docs.select(exactly(id_col).cast("long").alias("doc_id"), exactly(text_col).cast("string").alias("text"), place.alias("chunk"))
    return rows.repartition(partitions(docs.sparkSession), "chunk"), n


def ask(chunks: DataFrame, question: Callable, replies: DataFrame | None = None, schema: str = BLOCK) -> DataFrame:
    """One call of ``question(chunk, documents, replies)`` per chunk; it returns a frame of ``schema``."""
    if replies is None:
        return chunks.groupBy("chunk").applyInPandas(lambda docs: question(int(docs["chunk"].iloc[0]), docs, None), schema)

    def both(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            raise ValueError("a reply without its chunk: the input changed between two rounds")
        return question(int(docs["chunk"].iloc[0]), docs, told)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(both, schema)


def answer(blocks: DataFrame, reply: Callable[[list[bytes]], list[bytes]], round_: int) -> DataFrame:
    """Answers per chunk and bucket: ``reply`` maps the blocks of a bucket, by chunk, to as many answers."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        return pd.DataFrame({"bucket": group["bucket"], "chunk": group["chunk"], "round": round_,
                             "payload": reply([bytes(p) for p in group["payload"]])})

    return blocks.groupBy("bucket").applyInPandas(one, BLOCK)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by bucket, and the bounds of the buckets in it."""
    bucket = (keys & np.uint64(0xFFFFFF)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def sent(chunk: int, order: np.ndarray, bounds: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pd.DataFrame:
    full = [b for b in range(len(bounds) - 1) if bounds[b] < bounds[b + 1]]
    return pd.DataFrame({"bucket": np.array(full, np.int32), "chunk": np.full(len(full), chunk, np.int32), "round": np.zeros(len(full), np.int32),
                         "payload": [pack(order[bounds[b]:bounds[b + 1]]) for b in full]})


def received(told: pd.DataFrame | None, round_: int) -> dict[int, bytes]:
    if told is None:
        return {}
    mine = told[told["round"] == round_]
    return {int(b): bytes(p) for b, p in zip(mine["bucket"], mine["payload"])}


def short(keys: np.ndarray) -> bytes:
    """The 40 bits of keys that do not choose the bucket."""
    return np.ascontiguousarray((keys >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def seen_twice(payloads: list[bytes]) -> list[bytes]:
    """Per block of distinct short keys: one bit per key, set if another block has it too."""
    sizes = [len(p) // 5 for p in payloads]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 5)
    keys = wide.view("<u8").reshape(-1)
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    bits = np.zeros(len(keys), bool)
    bits[order] = np.append(equal, False) | np.append(False, equal)
    return [np.packbits(b).tobytes() for b in np.split(bits, np.cumsum(sizes)[:-1])]


def marked_bits(told: dict[int, bytes], order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    bits = np.zeros(len(order), bool)
    for b, payload in told.items():
        n = bounds[b + 1] - bounds[b]
        bits[order[bounds[b]:bounds[b + 1]]] = np.unpackbits(np.frombuffer(payload, np.uint8), count=int(n)).astype(bool)
    return bits


def slices(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``SLICE_BYTES``."""
    begin = 0
    while begin < len(raws):
        end, taken = begin, 0
        while end < len(raws) and (end == begin or taken + len(raws[end]) <= SLICE_BYTES):
            taken += len(raws[end])
            end += 1
        yield begin, end
        begin = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def several(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each entry went, the lowest document of each, and if it has another one."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    unique, place = np.unique(keys, return_inverse=True)
    low = np.full(len(unique), LATEST)
    high = np.full(len(unique), np.iinfo(np.int64).min)
    np.minimum.at(low, place, docs)
    np.maximum.at(high, place, docs)
    return unique, place, low, low != high
