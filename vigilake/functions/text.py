"""Scalar text functions, Column -> Column, all built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake import fixed

BLANKS = " \t\n\r\x0b\x0c"
_MARK = "\x01"


def strip(col: Column) -> Column:
    """Drop leading and trailing blanks of every kind, not only spaces."""
    return F.btrim(col, F.lit(BLANKS))


def absent_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_group(col: Column, pattern: str) -> Column:
    """Group 1 of the first match; NULL where there is none or it is empty."""
    return absent_if_empty(F.regexp_extract(col, pattern, 1))


def captures(col: Column, pattern: str, groups: int) -> Column:
    """All groups of a start-anchored pattern as an array, NULL where it does not match.

    The pattern runs once per row: the match is rewritten to its groups with a mark
    between them and split there. Text that holds the mark itself takes the
    one-extract-per-group way.
    """
    whole = f"(?s:{pattern}.*)" if not pattern.startswith("(?") else None
    if whole is None:
        end = pattern.index(")") + 1
        whole = f"{pattern[:end]}(?:{pattern[end:]})(?s:.*)"
    template = _MARK + _MARK.join(f"${i}" for i in range(1, groups + 1))
    rewritten = F.regexp_replace(col, whole, template)
    quick = F.when(
        rewritten.startswith(_MARK), F.slice(F.split(rewritten, _MARK), 2, groups)
    )
    slow = F.when(
        col.rlike(pattern),
        F.array(*[F.regexp_extract(col, pattern, i) for i in range(1, groups + 1)]),
    )
    return F.when(col.contains(_MARK), slow).otherwise(quick)


def once(col: Column) -> Column:
    """The same value as a generated column. Filters on what is derived from it stay above
    it, so a costly expression runs once per row; pushed into a filter it would be
    repeated for every use. To be given a name of its own in a select or withColumn."""
    return F.explode(F.array(col))


def percent_decode(col: Column) -> Column:
    """Percent-decoding that keeps ``+`` and leaves broken sequences as they are."""
    guarded = F.regexp_replace(
        F.replace(col, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"
    )
    return F.when(col.contains("%"), F.try_url_decode(guarded)).otherwise(col)


def clean_key(col: Column) -> Column:
    """Last dotted part of a key, trimmed, lower case, blanks and dashes as ``_``."""
    last = F.element_at(F.split(col, r"\."), -1)
    return F.regexp_replace(F.lower(strip(last)), r"[\s\-]+", "_")


def occurrences(col: Column, text: str) -> Column:
    """How often a one-character text occurs."""
    return F.length(col) - F.length(F.replace(col, F.lit(text), F.lit("")))


def sniff_delimiter(header: Column) -> Column:
    """The most frequent delimiter candidate; ties go to the earlier, none gives a comma."""
    counts = [occurrences(header, d) for d in fixed.DELIMITERS]
    most = F.greatest(*counts)
    chain = F.when(most == 0, F.lit(fixed.DELIMITERS[0]))
    for delimiter, n in zip(fixed.DELIMITERS, counts):
        chain = chain.when(n == most, F.lit(delimiter))
    return chain


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def contains_all(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col.contains(w) for w in words])


def any_word(col: Column, words: list[str]) -> Column:
    """One alternation over plain words: the text is walked once for the whole list."""
    return col.rlike("|".join(w.replace("-", r"\-") for w in words))


def first_integer(col: Column) -> Column:
    return F.regexp_extract(col.cast("string"), r"\d+", 0).try_cast("int")


def event_type(event_id: Column) -> Column:
    """Name of a known event id, ``generic`` for the others."""
    names = F.create_map(*[F.lit(x) for pair in fixed.EVENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, event_id), F.lit("generic"))


def technique_path(technique: Column) -> Column:
    """Technique id as used in a reference address, ``T1110/001``."""
    found = absent_if_empty(F.regexp_extract(technique, r"T\d{4}(?:\.\d{3})?", 0))
    return F.coalesce(F.replace(found, F.lit("."), F.lit("/")), F.lit(fixed.DEFAULT_TECHNIQUE))


def technique_tags(technique: Column) -> Column:
    """``attack.t1110`` and, for a sub-technique, ``attack.t1110.001``."""
    main = absent_if_empty(F.regexp_extract(technique, r"T(\d{4})(?:\.(\d{3}))?", 1))
    sub = absent_if_empty(F.regexp_extract(technique, r"T(\d{4})(?:\.(\d{3}))?", 2))
    base = F.concat(F.lit("attack.t"), main)
    tags = F.array_compact(F.array(base, F.concat(base, F.lit("."), sub)))
    return F.when(main.isNull(), F.array(F.lit(fixed.DEFAULT_TAG))).otherwise(tags)


def severity_rank(severity: Column) -> Column:
    """Position in low < medium < high < critical."""
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity)


def risk_score(severity: Column) -> Column:
    scores = F.create_map(*[F.lit(x) for pair in fixed.RISK_SCORES.items() for x in pair])
    return F.coalesce(F.try_element_at(scores, severity), F.lit(fixed.DEFAULT_RISK_SCORE))


def risk_tier(count: Column) -> Column:
    return F.when(count > 50, "critical").when(count > 20, "high").otherwise("medium")
