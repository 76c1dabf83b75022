"""The same logs as real files: views are written as text and read through the file readers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.plans.analyze import events_for, load_events
from vigilake.session import shared_path
from vigilake.sources.delimited import read_csv_events
from vigilake.sources.json_docs import read_json_events
from vigilake.sources.lines import scan_text
from workloads.logs import YEAR, Logs


def opened(spark: SparkSession, path: str) -> str | None:
    """A folder made for files that tasks open by themselves; None on a store where Spark has to write them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        return None
    store.mkdirs(at)
    return store.makeQualified(at).toUri().getPath()


def storing(folder: str, line_sep: str):
    """Arrow batches of ``(source_file, value)`` rows, sorted by file -> a text file per name, as Spark's
    own writer names folders and ends lines; gives the number of files.

    For a local file Spark's writer starts a process per folder, file and checksum to set its mode, which
    takes longer than all else where files are small. A file gets its name once it is whole, and the same name
    when its task runs again.
    """
    run = uuid.uuid4().hex
    unnamed, escaped = "__HIVE_DEFAULT_PARTITION__", r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        last = f"part-{task.partitionId():05d}-{run}.txt"
        at, out, files = None, None, 0

        def close() -> None:
            if out:
                out.close()
                os.replace(f"{at}/.{last}.{task.taskAttemptId()}", f"{at}/{last}")

        for batch in batches:
            text = pc.binary_join_element_wise(pc.fill_null(batch.column("value"), ""), line_sep, "").cast(pa.large_string())
            _, offsets, data = text.buffers()
            starts, said = np.frombuffer(offsets, np.int64), memoryview(data) if data else b""
            runs = pc.run_end_encode(pc.fill_null(batch.column("source_file"), ""))
            begin = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                mine = f"{folder}/source_file=" + (re.sub(escaped, lambda c: f"%{ord(c[0]):02X}", name) or unnamed)
                if mine != at:
                    close()
                    at, files = mine, files + 1
                    os.makedirs(at, exist_ok=True)
                    out = open(f"{at}/.{last}.{task.taskAttemptId()}", "wb")  # noqa: SIM115
                out.write(said[starts[text.offset + begin]:starts[text.offset + end]])
                begin = end
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return store


class FileLogs(Logs):
    """``Logs`` whose lines and events come from files, one directory per view."""

    def folder(self, view: str, into: str | None = None, blank_line: bool = False) -> str:
        """The view as text files, one or more per ``source_file``, in order."""
        path = into or shared_path(self.spark, f"files-{view}")
        return self.filed(super().raw(view), path, "\n\n" if blank_line else "\n")

    def filed(self, lines: DataFrame, path: str, line_sep: str = "\n") -> str:
        """Lines as files below ``path``. The number of tasks is given, for thousands of small files are
        few bytes, which adaptive execution would leave to one task; and tasks put their files in
        place themselves, not the driver one after the other."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = lines.repartition(tasks, "source_file").sortWithinPartitions("source_file", "seq").select("source_file", "value")
        folder = opened(self.spark, path)
        if folder:
            rows.mapInArrow(storing(folder, line_sep), "files long").agg(F.sum("files")).collect()
        else:
            rows.write.mode("append").partitionBy("source_file").option("lineSep", line_sep).option(
                "mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return path

    @staticmethod
    def named(df: DataFrame) -> DataFrame:
        """Paths back to the names of the view."""
        return df.withColumn("source_file", F.regexp_extract("source_file", r"source_file=([^/]+)/", 1))

    def each(self, path: str) -> str:
        """The folders of the files below a path. Their names are no columns here, and Spark would look
        for columns in them in a time that grows with the square of their number."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatusIterator(at)
        while found.hasNext():
            if found.next().getPath().getName().startswith("source_file="):
                return f"{path}/source_file=*"
        return path

    def read(self, view: str, log_type: str, **options) -> DataFrame:
        return self.named(events_for(self.spark, log_type, self.each(self.folder(view, **options)), YEAR))

    def raw(self, view: str) -> DataFrame:
        return self.named(scan_text(self.spark, self.each(self.folder(view))))

    @cached_property
    def auth(self):
        return self.read("auth_lines", "auth")

    @cached_property
    def web(self):
        return self.read("web_lines", "apache")

    @cached_property
    def win(self):
        return self.read("win_lines", "windows")

    @cached_property
    def blocks(self):
        return self.read("win_blocks", "windows", blank_line=True)

    @cached_property
    def csv(self):
        return self.read("firewall_lines", "csv")

    @cached_property
    def cloud(self):
        return self.read("cloud_lines", "json")

    @cached_property
    def documents(self):
        # a file per document: the layout is given, so that nothing has to be probed
        return self.named(read_json_events(self.spark, self.each(self.folder("cloud_documents")), "document"))

    @cached_property
    def winevent(self):
        return self.read("winevent_records", "xml")

    @cached_property
    def xml(self):
        return self.read("xml_records", "xml")


class QuotedLogs(FileLogs):
    """Firewall files whose quoted notes go over two lines."""

    @cached_property
    def csv(self):
        rows = Logs.raw(self, "firewall_lines").withColumn("value", F.replace("value", F.lit("a, quoted"), F.lit("a,\nquoted")))
        path = self.filed(rows, shared_path(self.spark, "files-quoted"))
        return self.named(read_csv_events(self.spark, self.each(path), multiline=True))


def directory_counts(logs: Logs, more: tuple[str, ...] = ()) -> DataFrame:
    """Events per file and type of one directory of many formats, known by content alone.

    Without the firewall files: their uneven rows are no CSV by content, only by name. ``more`` adds views.
    """
    files = FileLogs(logs.spark, logs.sf_dir)
    path = shared_path(logs.spark, "files-all")
    for view in ("auth_lines", "web_lines", "win_lines", "cloud_lines", "winevent_records", *more):
        files.folder(view, path)
    files.folder("win_blocks", path, blank_line=True)
    events = files.named(load_events(logs.spark, files.each(path), YEAR))
    return events.groupBy("source_file", "log_type").agg(F.count(F.lit(1)).alias("n"))


def directory_of_all(logs: Logs) -> DataFrame:
    """The same with every format there is: CSV, whole JSON documents and plain XML elements too."""
    return directory_counts(logs, ("firewall_even", "cloud_day_documents", "xml_records"))
