"""Raw log files as streams.

Line formats are parsed inside the stream. Formats that need their whole file (headers,
layouts, documents) go through ``ingest``: a stream of file names, a bounded number per
batch, each batch read by the batch readers and stored under its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilake.plans.analyze import events_for, load_events
from vigilake.schema import EVENT_COLUMNS
from vigilake.session import configure
from vigilake.sources.auth import auth_events
from vigilake.sources.json_docs import json_line_events
from vigilake.sources.lines import as_paths
from vigilake.sources.web import web_events
from vigilake.sources.windows import win_tabular_events
from vigilake.sources.xml_docs import xml_record_events

LINE_FORMATS = ("auth", "generic", "apache", "windows", "json", "xml")
EVERY = "15 minutes"


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """``(source_file, seq, value)`` lines of a growing folder, ``max_files`` files per batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("seq"), "value").mapInArrow(
        _numbered, "source_file string, seq long, value string")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start of the split and row number inside the task, as ``lines.sequence`` has it; streams know no
    running number of their own."""
    done = 0
    for batch in batches:
        at = pc.add(batch.column("seq"), pa.array(np.arange(done, done + batch.num_rows)))
        done += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("source_file"), at, batch.column("value")], names=["source_file", "seq", "value"])


def stream_events(spark: SparkSession, path: str, log_type: str, max_files: int = 1000, default_year: int | None = None) -> DataFrame:
    """Events of a growing folder of one line format: one record per line (Windows exports in
    the tabular layout, JSON Lines, one XML event per line)."""
    lines = stream_lines(configure(spark), path, max_files)
    if log_type in ("auth", "generic"):
        return auth_events(lines, default_year, log_type)
    if log_type in LINE_FORMATS:
        return {"apache": web_events, "windows": win_tabular_events, "json": json_line_events, "xml": xml_record_events}[log_type](lines)
    raise ValueError(f"{log_type!r} needs its whole file: use ingest")


def stored_batch(spark: SparkSession, path: str) -> bool:
    """Whether a batch folder was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def triggered(writer, once: bool, every: str = EVERY):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def ingest(spark: SparkSession, path: str, output: str, checkpoint: str, log_type: str | None = None, max_files: int = 1000,
           default_year: int | None = None, once: bool = False, every: str = EVERY) -> StreamingQuery:
    """Parse new files of a folder into ``output/batch=N``, every 15 minutes or once over what is there.

    ``log_type`` None: every file is routed by name or content, any mix of formats. Only names
    travel through the driver, at most ``max_files`` of one batch; contents are not read to find
    them. A batch that is run again after a crash leaves a whole folder as it is and replaces one
    that was cut off, so the table holds every record once. ``read_ingested`` reads it.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    names = spark.readStream.schema(kind).format("binaryFile").option("maxFilesPerTrigger", max_files).load(path).select(F.col("_metadata.file_path").alias("path"))

    def store(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        target = f"{output}/batch={n}"
        if stored_batch(session, target):
            return
        files = as_paths(sorted(r["path"] for r in batch.collect()))
        if files:
            found = events_for(configure(session), log_type, files, default_year) if log_type else load_events(session, files, default_year)
            found.write.mode("overwrite").parquet(target)

    return triggered(names.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), once, every).start()


def read_ingested(spark: SparkSession, output: str, streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """Events that ``ingest`` has stored, as a table or as a stream."""
    schema = ", ".join(f"{name} {kind}" for name, kind in EVENT_COLUMNS.items()) + ", batch long"
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if streaming else spark.read
    return reader.schema(schema).parquet(output)
