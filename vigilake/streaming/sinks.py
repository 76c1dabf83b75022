"""Events of a stream kept whole, late ones in a table of their own as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilake.streaming.raw import stored_batch, triggered


def batch_watermark(spark: SparkSession, path: str, n: int, delay: str):
    """Latest time of all batches before ``n`` less the delay; None for the first."""
    before = f"{path}/progress/batch={n - 1}"
    if n == 0 or not stored_batch(spark, before):
        return None
    return spark.read.parquet(before).select((F.col("latest") - F.expr(f"interval {delay}")).alias("at")).first()["at"]


def store_batch(batch: DataFrame, n: int, path: str, delay: str, window: str, time: str = "event_ts") -> None:
    """One micro-batch into ``events``, ``late`` and ``progress`` under its number.

    Late are rows whose window had ended, by the times of all batches before, when they came; windows
    with this delay leave them out (in the one batch after its watermark moved, a window query may
    still count them). What is late follows from the batches before alone, and every folder is
    replaced as a whole, so a batch that runs again gives the same tables.
    """
    spark = batch.sparkSession
    mine = f"{path}/events/batch={n}"
    batch.write.mode("overwrite").parquet(mine)
    rows = spark.read.schema(batch.schema).parquet(mine)  # the source is parsed once
    mark = batch_watermark(spark, path, n, delay)
    late = rows.filter(F.window(time, window)["end"] <= F.lit(mark)) if mark else rows.limit(0)
    late.write.mode("overwrite").parquet(f"{path}/late/batch={n}")
    latest = rows.agg(F.max(time).alias("latest")).first()["latest"]
    if n and stored_batch(spark, f"{path}/progress/batch={n - 1}"):
        earlier = spark.read.parquet(f"{path}/progress/batch={n - 1}").first()["latest"]
        latest = max((x for x in (latest, earlier) if x is not None), default=None)
    spark.createDataFrame([(latest,)], "latest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/batch={n}")


def keep_with_late(events: DataFrame, path: str, checkpoint: str, delay: str, window: str = "10 minutes", time: str = "event_ts",
                   once: bool = False) -> StreamingQuery:
    """Every event of a stream to ``path/events``, the late ones to ``path/late`` as well (``store_batch``)."""
    writer = events.writeStream.foreachBatch(lambda batch, n: store_batch(batch, n, path, delay, window, time))
    return triggered(writer.option("checkpointLocation", checkpoint), once).start()


def read_kept(spark: SparkSession, path: str, schema, table: str = "events") -> DataFrame:
    """The events, or the late ones, of all batches so far."""
    return spark.read.schema(schema).parquet(f"{path}/{table}/batch=*")
