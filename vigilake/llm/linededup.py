"""Line dedup by range-partitioned hashes and keep bitmaps (operator 13).

Every long line becomes a row of numbers: 128 bits of its key, the document, the place. The
rows are range-partitioned by (hash, document, place), so that a line in very many documents
spreads over as many partitions as it fills, and sorted inside them with the largest document
first: the first occurrence met in a stream is the one that stays. Runs of one hash that touch
the edge of a partition are settled by a table of a few rows per partition. What comes back
to a document is no text but a compressed bitmap of the lines it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, LOWER, exactly, partitions, written

#: Lines, or bytes of text, that a task hands over at a time.
ROWS, BYTES = 50_000, 4_000_000
FIELDS = ("h1", "h2", "doc", "row", "line", "lines")
SETTLED = pa.schema([("kind", pa.string()), ("task", pa.int32()), *[(f, pa.int64()) for f in FIELDS],
                     ("docs", pa.int64()), ("top", pa.int64()), ("low", pa.int64())])
SETTLED_SQL = "kind string, task int, " + ", ".join(f"{f} long" for f in FIELDS) + ", docs long, top long, low long"


def row_key(text: Column) -> Column:
    """With the document id it tells rows apart; rows equal in both keep and lose the same lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """One row of numbers per line whose key has at least ``least`` code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, rows = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            found: list[tuple[bytes, int, int, int]] = []
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                cut = text.as_py().translate(LOWER).split(b"\n")
                for at, line in enumerate(cut):
                    if len(line) >= least and len(key := line.strip(BLANKS)) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                        found.append((xxhash.xxh3_128_digest(key), k, at, len(cut)))
                if len(found) >= ROWS:
                    yield numbered(found, ids, rows)
                    found = []
            if found:
                yield numbered(found, ids, rows)

    text = exactly(text_col).cast("string")
    rows = docs.where(exactly(id_col).isNotNull() & (F.length(text) >= least)).select(
        exactly(id_col).cast("long").alias("doc"), row_key(text).alias("row"), text.alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{f} long" for f in FIELDS))


def numbered(found: list[tuple[bytes, int, int, int]], ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    keys, at, line, lines = zip(*found)
    halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    at = np.array(at)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (halves[:, 0], halves[:, 1], ids[at], rows[at])]
                                      + [pa.array(x, pa.int64()) for x in (line, lines)], names=list(FIELDS))


class Stream:
    """Rows of one sorted partition -> lines to drop, and what only its neighbours can settle."""

    def __init__(self, task: int, copies: int):
        self.task, self.copies = task, copies
        self.open = np.zeros((0, len(FIELDS)), np.int64)  # rows of the hash not settled yet
        self.edge = None  # hash the partition begins with; False once it is over
        self.hot = None  # the open hash once it has enough documents: [h1, h2, top, docs, low]
        self.pieces: dict[tuple[int, int], list[int]] = {}  # edge hash -> docs, top, low

    def batch(self, kind: str, rows: np.ndarray, docs=None, top=None, low=None) -> pa.RecordBatch:
        nothing = np.zeros(len(rows), np.int64)
        columns = [pa.array([kind] * len(rows), pa.string()), pa.array(np.full(len(rows), self.task, np.int32))]
        columns += [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(FIELDS))]
        columns += [pa.array(nothing if v is None else np.asarray(v, np.int64)) for v in (docs, top, low)]
        return pa.RecordBatch.from_arrays(columns, schema=SETTLED)

    def piece(self, key: tuple[int, int], rows: np.ndarray) -> None:
        """Counts documents of an edge hash; rows come with the largest document first."""
        docs = int((np.diff(rows[:, 2]) != 0).sum()) + 1
        if key not in self.pieces:
            self.pieces[key] = [docs, int(rows[0, 2]), int(rows[-1, 2])]
        else:
            had = self.pieces[key]
            had[0] += docs - (had[2] == int(rows[0, 2]))
            had[2] = int(rows[-1, 2])

    @staticmethod
    def leading(key, rows: np.ndarray) -> int:
        """How many rows at the front have this hash."""
        return int(np.argmin(np.append((rows[:, 0] == key[0]) & (rows[:, 1] == key[1]), False)))

    def feed(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.edge is None:
            self.edge = (int(rows[0, 0]), int(rows[0, 1]))
        if self.edge:  # rows of the first hash wait for the partitions before
            if n := self.leading(self.edge, rows):
                self.piece(self.edge, rows[:n])
                yield self.batch("edge", rows[:n])
                rows = rows[n:]
            if len(rows):
                self.edge = False
        if self.hot:
            h = self.hot
            if n := self.leading(h, rows):
                mine, rows = rows[:n], rows[n:]
                h[3] += int((np.diff(mine[:, 2], prepend=h[4]) != 0).sum())
                h[4] = int(mine[-1, 2])
                yield self.batch("drop", mine[mine[:, 2] != h[2]])
            if len(rows):
                self.hot = None
        if not len(rows):
            return
        rows = np.concatenate([self.open, rows])
        first = np.append(True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))
        fresh = first | np.append(True, np.diff(rows[:, 2]) != 0)
        start = np.flatnonzero(first)
        size = np.diff(start, append=len(rows))
        docs = np.add.reduceat(fresh.astype(np.int64), start)
        gone = np.repeat(docs >= self.copies, size) & (rows[:, 2] != np.repeat(rows[start, 2], size))
        if gone.any():
            yield self.batch("drop", rows[gone])
        last = rows[start[-1]:]
        if docs[-1] >= self.copies:
            self.hot = [int(last[0, 0]), int(last[0, 1]), int(last[0, 2]), int(docs[-1]), int(last[-1, 2])]
            self.open = rows[:0]
        else:
            self.open = last.copy()

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.open):
            key = (int(self.open[0, 0]), int(self.open[0, 1]))
            self.piece(key, self.open)
            yield self.batch("edge", self.open)
        if self.hot:
            self.pieces[(self.hot[0], self.hot[1])] = [self.hot[3], self.hot[2], self.hot[4]]
        if self.pieces:
            keys = np.zeros((len(self.pieces), len(FIELDS)), np.int64)
            keys[:, :2] = list(self.pieces)
            docs, top, low = zip(*self.pieces.values())
            yield self.batch("piece", keys, docs, top, low)


def keep_bitmaps(docs: DataFrame, least: int = 40, copies: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_lines, n_dropped, keep for the documents that lose lines.

    A line's key is the line without the six ASCII blanks at both ends, A-Z in lower case. A key
    of ``least`` code points or more, found in ``copies`` or more documents, loses its lines in all
    but the largest id. ``keep`` is a zlib-compressed bitmap, highest bit first, a bit per line; ``row``
    the ``row_key`` of the text. Rows of one id are one document: repeats of a key inside it count
    once, and all stay where it has the largest id. Rows without id or text lose nothing and do not
    count. Keys are compared by 128 bits. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    lines = long_lines(docs, least, id_col, text_col)
    order = ["h1", "h2", F.desc("doc"), "row", "line"]
    sorted_ = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = Stream(TaskContext.get().partitionId(), copies)
        for b in batches:
            if b.num_rows:
                yield from stream.feed(np.stack([b.column(f).to_numpy() for f in FIELDS], axis=1))
        yield from stream.end()

    found = written(sorted_.mapInArrow(settle, SETTLED_SQL), "lines")
    # a few rows per partition: one hash may go on through several of them
    after = Window.partitionBy("h1", "h2").orderBy(F.desc("top"), F.desc("low"), "task")
    shared = (F.lag("low").over(after) == F.col("top")).cast("long")
    pieces = found.where("kind = 'piece'").select("h1", "h2", "top", (F.col("docs") - F.coalesce(shared, F.lit(0))).alias("docs"))
    often = pieces.groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("top").alias("most")).where(F.col("n") >= copies)
    edges = found.where("kind = 'edge'").join(F.broadcast(often.drop("n")), ["h1", "h2"]).where("doc < most")
    places = ["doc", "row", "lines", "line"]
    gone = found.where("kind = 'drop'").select(places).union(edges.select(places))
    of_row = gone.groupBy("doc", "row").agg(F.max("lines").alias("n_lines"), F.collect_set("line").alias("gone"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for n, places in zip(batch["n_lines"], batch["gone"]):
                bits = np.ones(int(n), bool)
                bits[np.asarray(places, np.int64)] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pd.DataFrame({"doc_id": batch["doc"], "row": batch["row"], "n_lines": batch["n_lines"],
                                "n_dropped": [len(g) for g in batch["gone"]], "keep": keep})

    return of_row.mapInPandas(pack, "doc_id long, row long, n_lines long, n_dropped long, keep binary")


def kept_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept per row of ``docs``: the lines its bitmap keeps, joined by line feeds.

    A null or empty text is one empty line. Rows without a bitmap keep their text as it is.
    """
    text = exactly(text_col).cast("string")
    rows = docs.select(exactly(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), row_key(text).alias("row"))
    both = rows.join(bitmaps.select("doc_id", "row", "n_dropped", "keep"), ["doc_id", "row"], "left")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keeps, dropped = (batch.column(f) for f in ("doc_id", "text", "keep", "n_dropped"))
            begin, kept, n_lines, used = 0, [], [], 0
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                used += len(text)
                n_lines.append(text.count("\n") + 1)
                if (keep := keeps[k].as_py()) is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines[-1])
                    text = "\n".join(compress(text.split("\n"), bits.tolist()))
                kept.append(text)
                if used >= BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, len(kept)), pa.array(n_lines, pa.int64()), dropped.slice(begin, len(kept)).fill_null(0),
                                                      pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])
                    begin, kept, n_lines, used = k + 1, [], [], 0

    return both.select("doc_id", "text", "keep", "n_dropped").mapInArrow(applied, "doc_id long, n_lines long, n_dropped long, kept string")


def without_lines(docs: DataFrame, least: int = 40, copies: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``kept_lines`` by the ``keep_bitmaps`` of the same table; see both."""
    bitmaps = written(keep_bitmaps(docs, least, copies, id_col, text_col), "keep-bitmaps")
    return kept_lines(docs, bitmaps, id_col, text_col)


DIGEST_SQL = rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  e AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
  often AS (SELECT key, max(doc_id) AS most FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  m AS (SELECT k.doc_id, i, line, coalesce(k.doc_id < most, false) AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
