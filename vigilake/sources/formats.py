"""Which format is a file? By extension, else by the first lines of its content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import text


def extension_dimension(spark: SparkSession) -> DataFrame:
    """Known extensions, a handful of literal rows."""
    rows = [F.struct(F.lit(e).alias("extension"), F.lit(t).alias("log_type")) for e, t in fixed.EXTENSION_FORMATS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def extension(source_file: Column) -> Column:
    """Lower-case extension of the file name; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(source_file, r"[^/](\.[^./]+)$", 1))


def route_by_extension(files: DataFrame) -> DataFrame:
    """``(source_file, log_type)``, NULL where the extension says nothing."""
    return files.withColumn("extension", extension(F.col("source_file"))).join(
        F.broadcast(extension_dimension(files.sparkSession)), "extension", "left"
    ).drop("extension")


def head_lines(lines: DataFrame, count: int = fixed.SAMPLE_LINES) -> DataFrame:
    """First lines per file with their position. The rank filter also runs before the
    shuffle, so each task sends at most ``count`` lines per file."""
    order = Window.partitionBy("source_file").orderBy("seq")
    return lines.withColumn("line_no", F.row_number().over(order)).filter(F.col("line_no") <= count)


def detect_formats(lines: DataFrame) -> DataFrame:
    """``(source_file, log_type, auth_score, apache_score, windows_score)`` by content.

    Lines are ``(source_file, seq, value)`` as scanned, blank ones included. At most 50
    lines per file reach the aggregate.
    """
    head = head_lines(lines).withColumn("trimmed", text.strip(F.col("value")))
    value = F.col("value")
    filled = F.col("trimmed") != ""
    hits = {
        f"{kind}_{i}": F.max(value.rlike(p)).cast("int")
        for kind, patterns in fixed.FORMAT_SIGNATURES.items() for i, p in enumerate(patterns)
    }
    sample = F.array_sort(F.collect_list(F.struct("line_no", "value")))["value"]
    per_file = head.groupBy("source_file").agg(
        F.min_by("trimmed", F.when(filled, F.col("line_no"))).alias("first"),
        text.strip(F.array_join(sample, "\n")).alias("sample"),
        F.slice(F.filter(sample, lambda v: text.strip(v) != ""), 1, fixed.CSV_SAMPLE_LINES).alias("top"),
        *[c.alias(n) for n, c in hits.items()],
    ).withColumns({
        f"{kind}_score": reduce(lambda a, b: a + b, [F.col(f"{kind}_{i}") for i in range(len(p))])
        for kind, p in fixed.FORMAT_SIGNATURES.items()
    })
    first, top = F.col("first"), F.col("top")
    json_start = first.startswith("{") | first.startswith("[")
    parses = F.try_parse_json(F.col("sample")).isNotNull() | F.try_parse_json(first).isNotNull()

    def even(delimiter: str) -> Column:
        counts = F.transform(top, lambda v: text.occurrences(v, delimiter))
        return (counts[0] > 1) & (F.array_min(counts) == F.array_max(counts))

    csv_like = (F.size(top) >= 2) & reduce(lambda a, b: a | b, [even(d) for d in fixed.DELIMITERS])
    scores = [F.col(f"{kind}_score") for kind in fixed.FORMAT_SIGNATURES]
    best = F.greatest(*scores)
    by_score = F.when(best == 0, "generic")
    for kind, score in zip(fixed.FORMAT_SIGNATURES, scores):
        by_score = by_score.when(score == best, kind)
    log_type = (
        F.when(first.startswith("<"), "xml").when(json_start & parses, "json")
        .when(F.coalesce(csv_like, F.lit(False)), "csv").otherwise(by_score)
    )
    return per_file.select("source_file", log_type.alias("log_type"), *[f"{k}_score" for k in fixed.FORMAT_SIGNATURES])


def route_files(lines: DataFrame) -> DataFrame:
    """``(source_file, log_type)``: the extension decides where it is known, else content."""
    by_content = detect_formats(lines).select("source_file", F.col("log_type").alias("by_content"))
    return route_by_extension(by_content).select(
        "source_file", F.coalesce("log_type", "by_content").alias("log_type")
    )
