"""Top-k, first-k, distinct and ordering of keyed counts and findings.

Rank filters stand directly on the window, so Spark also applies them before the shuffle
and a huge scope sends at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.text import severity_rank


def key_counts(events: DataFrame, scope: str, key: str, order: str = "seq") -> DataFrame:
    """``(scope, key, n, first_seq)``; records without the key are left out."""
    return events.filter(F.col(key).isNotNull()).groupBy(scope, key).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seq")
    )


def _ranked(df: DataFrame, scope: str, k: int, *order) -> DataFrame:
    window = Window.partitionBy(scope).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def top_k(events: DataFrame, scope: str, key: str, k: int, order: str = "seq") -> DataFrame:
    """The k most frequent keys per scope; ties go to the key seen first."""
    return _ranked(key_counts(events, scope, key, order), scope, k, F.desc("n"), "first_seq")


def first_k_keys(events: DataFrame, scope: str, key: str, k: int, order: str = "seq") -> DataFrame:
    """The k keys seen first per scope."""
    return _ranked(key_counts(events, scope, key, order), scope, k, "first_seq")


def first_k(events: DataFrame, scope: str, k: int, order: str = "seq") -> DataFrame:
    """The first k records per scope."""
    return _ranked(events, scope, k, order)


def first_record(events: DataFrame, scope: str, order: str = "seq") -> DataFrame:
    """Text of the first record per scope."""
    return events.groupBy(scope).agg(F.min_by("raw", order).alias("sample_entry"))


def distinct_values(events: DataFrame, scope: str, key: str) -> DataFrame:
    """Number of different values per scope. Spark counts them in two shuffles, the first
    on the value itself, so no task holds a scope's whole value set."""
    return events.groupBy(scope).agg(F.count_distinct(key).alias("distinct_values"))


def order_findings(findings: DataFrame) -> DataFrame:
    """Severity descending; inside one severity the order of the rules."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "rule_order", "scope")


def filter_severity(findings: DataFrame, minimum: str = "all") -> DataFrame:
    """Findings of at least this severity; ``all`` keeps everything."""
    if minimum == "all":
        return findings
    return findings.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(minimum)))
