"""Contiguous shards of equal bytes from global prefix sums (operator 8).

Rows are put in one global order over range partitions. Each partition adds up its own
sizes; the prefix sums of these few totals turn every running sum inside a partition into
a position in the whole. Cuts at equal targets of that position give the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exactly, partitions, written


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
           carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns named in ``carry``.

    Order is by id (nulls first), checksum, then place in the input, so one id may hold any
    share of the rows: its rows still spread over partitions. A row belongs to the shard in
    which the middle of its bytes lies; shards differ by less than two rows' bytes. Null and
    empty texts have size 1 and checksum 0; repeated rows are rows of their own; an empty
    table gives no rows. A text longer than a shard's target leaves other shards empty.
    Columns in ``carry`` come back as ``<name>`` unless a result column has that name.
    """
    spark = docs.sparkSession
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in carry if c not in own]
    text = F.coalesce(exactly(text_col), F.lit(""))
    rows = docs.select(
        exactly(id_col).alias("__id"), (F.octet_length(text) + 1).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"), F.monotonically_increasing_id().alias("__row"),
        *[exactly(c).alias(f"__c{i}") for i, c in enumerate(kept)],
    )
    order = ["__id", "__crc", "__row"]
    # the partition number is fixed by writing it: a repeated task may not draw other bounds
    placed = written(rows.repartitionByRange(partitions(spark), *order)
                     .withColumn("__part", F.spark_partition_id()), "shard-order")
    totals = placed.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    prefix = totals.select(
        "__part", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"),
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    running = placed.select(
        "*", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("__in"),
        F.row_number().over(inside).alias("__at"),
    )
    # prefix has one row per partition of the shuffle: small by construction
    ranked = running.join(F.broadcast(prefix), "__part").withColumn(
        "shard", F.expr(f"cast((cast(2 * (__bytes_before + coalesce(__in, 0)) + __size as decimal(20,0)) * {int(n_shards)})"
                        " div cast(2 * __all as decimal(20,0)) as int)")
    ).withColumn("__rank", F.col("__rows_before") + F.col("__at") - 1)
    first = ranked.groupBy("shard").agg(F.min("__rank").alias("__first"))  # one row a shard
    return ranked.join(F.broadcast(first), "shard").select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", (F.col("__rank") - F.col("__first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)],
    )
