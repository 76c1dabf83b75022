"""Selections as portable rules state them, as filters over events. All ignore case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import text


def _lower(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


def keyword_match(keywords: list[str], column: str = "raw") -> Column:
    return text.contains_any(F.lower(column), _lower(keywords))


def select_keywords(events: DataFrame, keywords: list[str]) -> DataFrame:
    """Any keyword in the record text."""
    return events.filter(keyword_match(keywords))


def uri_query(target: Column) -> Column:
    """Part of the request target after the first ``?``; NULL where there is none."""
    return F.when(target.contains("?"), F.regexp_replace(target, r"(?s)^[^?]*\?", ""))


def uri_path(target: Column) -> Column:
    return F.substring_index(target, "?", 1)


def select_query_keywords(events: DataFrame, keywords: list[str]) -> DataFrame:
    """All of the first three keywords and any of all in the query of the request."""
    query, words = F.lower(uri_query(F.col("target"))), _lower(keywords)
    return events.filter(text.contains_all(query, words[:3]) & text.contains_any(query, words))


def select_event_ids(events: DataFrame, event_ids: list[int]) -> DataFrame:
    return events.filter(F.col("event_id").isin(event_ids))


def field_match(keywords: list[str]) -> Column:
    words = _lower(keywords)
    return F.exists(
        F.map_values("fields"),
        lambda v: reduce(lambda a, b: a | b, [F.lower(v).contains(w) for w in words]),
    )


def select_fields(events: DataFrame, keywords: list[str]) -> DataFrame:
    """Any keyword in any field of a structured record."""
    return events.filter(field_match(keywords))


def select_fallback(events: DataFrame, rule_name: str, keywords: list[str] | None = None) -> DataFrame:
    """Keywords, or else the rule's own name, in the record text."""
    return events.filter(keyword_match(keywords or [rule_name]))


def select_flag(events: DataFrame, name: str) -> DataFrame:
    """Records that carry a flag."""
    return events.filter(F.col(name))
