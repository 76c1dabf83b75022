"""Vector code compression by member-resident Lloyd rounds (operator 12).

Vectors are cut into parts of whole numbers, and every part is a member of the codebook entry
nearest to it. Members lie with their owner (position, entry, salt). In a round the owners
sum their resident members, which gives the next codebooks; then each tests its members
against them, keeps those that stay and sends only the others through a shuffle to their new
owners. The salt spreads the members of an entry over as many owners as there are tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exactly, partitions, shared_path, written

SCALE = 1024
#: Components from here on are as good as not finite: squared distances would not fit into a long.
LIMIT = 2.0 ** 19
#: Vectors tested at a time.
ROWS = 4096
MEMBER = "position int, entry int, salt int, part binary"
MEMBERS = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("part", pa.binary())])
OWNER = ("position", "entry", "salt")


class Books:
    """Codebooks of all positions, and exact nearest entries.

    Products are done in doubles where every sum stays below 2 ** 53, else in 64-bit integers.
    """

    def __init__(self, entries: list[np.ndarray], largest: int):
        self.entries = entries
        wide = max((e.shape[1] for e in entries), default=0)
        self.kind = np.float64 if 4 * wide * (largest + 1) ** 2 < 2 ** 53 else np.int64
        self.stored = np.int16 if largest < 2 ** 15 else np.int32
        self.turned = [np.ascontiguousarray(e.T).astype(self.kind) for e in entries]
        self.squares = [(e.astype(self.kind) ** 2).sum(1) for e in entries]
        self.largest = largest

    def nearest(self, position: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest nearest entry and squared distance of each row."""
        best, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for begin in range(0, len(parts), ROWS):
            x = parts[begin:begin + ROWS].astype(self.kind)
            d = self.squares[position] - 2 * (x @ self.turned[position])
            at = d.argmin(1)
            best[begin:begin + ROWS] = at
            far[begin:begin + ROWS] = (d[np.arange(len(x)), at] + (x * x).sum(1)).astype(np.int64)
        return best, far

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.reshape(-1)).encode()).hexdigest()


def usable(vectors: DataFrame, vector_col: str) -> Column:
    v = exactly(vector_col).cast("array<double>")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(1024 x)."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * SCALE).astype(np.int64)


def members_of(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, parts: list[bytes], **more) -> pa.RecordBatch:
    schema = MEMBERS
    for name in more:
        schema = schema.append(pa.field(name, pa.bool_()))
    columns = [pa.array(np.asarray(x, np.int32)) for x in (position, entry, salt)] + [pa.array(parts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in more.values()], schema=schema)


class Resident:
    """The members' tables of the current round, in the shared folder."""

    def __init__(self, spark, bounds: list[int]):
        self.spark, self.bounds, self.paths, self.tables = spark, bounds, [], None

    def replace(self, paths: list[str], tables: DataFrame) -> None:
        """The tables of the round before go once these are whole."""
        for old in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths, self.tables = paths, tables

    def stored(self, df: DataFrame, name: str, *by: str) -> tuple[str, DataFrame]:
        path = shared_path(self.spark, name)
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def settle(self, vectors: DataFrame, books: Books) -> None:
        """First round: every part goes to the owner of its nearest entry."""
        bounds = self.bounds

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, salt = whole(b.column("v"), bounds[-1]), b.column("salt").to_numpy()
                for p in range(len(bounds) - 1):
                    part = x[:, bounds[p]:bounds[p + 1]]
                    entry = books.nearest(p, part)[0]
                    yield members_of(np.full(len(x), p), entry, salt, [r.tobytes() for r in part.astype(books.stored)])

        dealt = vectors.select("v", "salt").mapInArrow(assign, MEMBER).repartition(partitions(self.spark), *OWNER)
        path, table = self.stored(dealt, "members")
        self.replace([path], table)

    def migrate(self, books: Books) -> None:
        """Members that stay are written where they are; only the others are shuffled."""
        bounds = self.bounds

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                position, entry = b.column("position").to_numpy(), b.column("entry").to_numpy()
                now = entry.copy()
                for p in np.unique(position):
                    mine = np.flatnonzero(position == p)
                    now[mine] = books.nearest(p, parts_of(b, mine, bounds[p + 1] - bounds[p], books))[0]
                yield members_of(position, now, b.column("salt").to_numpy(), b.column("part"), moved=now != entry)

        path, tested = self.stored(self.tables.mapInArrow(test, f"{MEMBER}, moved boolean"), "tested", "moved")
        names = [f.split()[0] for f in MEMBER.split(", ")]
        movers = tested.where("moved").select(names).repartition(partitions(self.spark), *OWNER)
        to, arrived = self.stored(movers, "arrived")
        self.replace([path, to], tested.where("NOT moved").select(names).unionByName(arrived))

    def update(self, books: Books) -> Books:
        """Owners sum their members; entries without any stay as they are."""
        bounds = self.bounds
        wide = max(np.diff(bounds))
        n_entries = len(books.entries[0])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(bounds) - 1, n_entries, wide), np.int64)
            count = np.zeros((len(bounds) - 1, n_entries), np.int64)
            for b in batches:
                position, entry = b.column("position").to_numpy(), b.column("entry").to_numpy()
                for p in np.unique(position):
                    mine = np.flatnonzero(position == p)
                    np.add.at(total[p, :, :bounds[p + 1] - bounds[p]], entry[mine], parts_of(b, mine, bounds[p + 1] - bounds[p], books).astype(np.int64))
                    count[p] += np.bincount(entry[mine], minlength=n_entries)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                                              pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["position", "entry", "n", "sums"])

        partial = self.tables.mapInArrow(sums, "position int, entry int, n long, sums array<long>")
        whole_ = partial.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(wide)])
        entries = [e.copy() for e in books.entries]
        for row in whole_.collect():  # one row per entry of the codebooks, whatever the number of vectors
            p = row["position"]
            entries[p][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(bounds[p + 1] - bounds[p])]
        return Books(entries, books.largest)


def parts_of(batch: pa.RecordBatch, mine: np.ndarray, width: int, books: Books) -> np.ndarray:
    raw = b"".join(batch.column("part").take(pa.array(mine)).to_pylist())
    return (np.frombuffer(raw, books.stored) if raw else np.zeros(0, books.stored)).reshape(len(mine), width)


def fitted(vectors: DataFrame, n_parts: int, n_entries: int, rounds: int) -> tuple[Books | None, list[int]]:
    """Codebooks of (v, id, salt) rows, and the bounds of the parts."""
    seen = vectors.agg(F.min(F.struct(F.col("id").isNull(), "id", F.col("v").alias("v"))).alias("first"),
                       F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    if seen["first"] is None:
        return None, []
    dim = len(seen["first"]["v"])
    largest = int(np.floor(seen["largest"] * SCALE)) + 1
    bounds = [dim * k // n_parts for k in range(n_parts + 1)]
    vectors = vectors.where(F.size("v") == dim)
    seeds = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(n_entries).select("v").collect()
    x = np.floor(np.array([r["v"] for r in seeds]) * SCALE).astype(np.int64)
    books = Books([x[:, a:b].copy() for a, b in zip(bounds, bounds[1:])], largest)
    resident = Resident(vectors.sparkSession, bounds)
    for k in range(rounds):
        resident.migrate(books) if k else resident.settle(vectors, books)
        books = resident.update(books)
    resident.replace([], None)
    return books, bounds


def compressed(vectors: DataFrame, n_parts: int = 4, n_entries: int = 256, rounds: int = 4, id_col: str = "vec_id",
               vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books | None]:
    """(id, label, code, error, label_error) per usable row, and the codebooks.

    Components are floor(1024 x). Rows whose vector is null or empty, holds a component that is null,
    not finite or 2 ** 19 or more, or has another length than the vector of the smallest id are dropped.
    Lengths that ``n_parts`` does not divide give parts of unequal lengths. The codebooks start from the
    ``n_entries`` smallest ids (nulls last, equal ids by vector; fewer rows give fewer entries). Equal
    ids and repeated rows are rows of their own. ``label_error`` sums the errors of equal labels, nulls
    together. Extra columns are ignored; an empty table gives no rows and no codebooks.
    """
    if n_entries > 256:
        raise ValueError("an entry has two hex digits: 256 entries at most")
    spark = vectors.sparkSession
    known = vectors.where(usable(vectors, vector_col)).select(
        exactly(id_col).alias("id"), exactly(label_col).alias("label"), exactly(vector_col).cast("array<double>").alias("v"))
    known = known.withColumn("salt", F.pmod(F.xxhash64("id", "label"), F.lit(partitions(spark))).cast("int"))
    books, bounds = fitted(known, n_parts, n_entries, rounds)
    out = known.select("id", "label").schema.add("code", "string").add("error", "long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column("v"), bounds[-1])
            code, error = np.zeros((len(x), len(bounds) - 1), np.uint8), np.zeros(len(x), np.int64)
            for p in range(len(bounds) - 1):
                code[:, p], far = books.nearest(p, x[:, bounds[p]:bounds[p + 1]])
                error += far
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()),
                                              pa.array(error)], names=["id", "label", "code", "error"])

    if books is None:
        return spark.createDataFrame([], out).withColumn("label_error", F.col("error")), None
    coded = written(known.where(F.size("v") == bounds[-1]).select("id", "label", "v").mapInArrow(encode, out), "codes")
    per_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    both = coded.join(per_label.withColumnRenamed("label", "same"), F.col("label").eqNullSafe(F.col("same"))).drop("same")
    return both, books


def digest_sql(rounds: int = 4) -> str:
    """The same over whole vectors in plain SQL: every component is a row, every entry is tried."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
             """c AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(x) // 4) AS part, (i - 1) % (len(x) // 4) AS place, x[i] AS x
    FROM v, unnest(range(1, len(x) + 1)) AS r(i))""",
             """b0 AS MATERIALIZED (SELECT part, entry, place, x FROM c
    JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 256) USING (vec_id))"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + entry) AS best FROM (
    SELECT vec_id, c.part, entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{k} b USING (part, place) GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, best % 256 AS entry, place, floor(sum(x) / count(*))::BIGINT AS x FROM a{k} JOIN c USING (vec_id, part) GROUP BY ALL) n
    USING (part, entry, place))""")
    return "WITH " + ",\n  ".join(steps) + f""",
  coded AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)"""
