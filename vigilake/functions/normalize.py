"""Structured records -> canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import flags, text
from vigilake.schema import to_events


def alias_places(names: Column) -> Column:
    """Cleaned column names of a file -> per canonical field the columns (from 0) that may fill it:
    aliases in order, of columns with the same name the last first."""
    def of(aliases: list[str]) -> Column:
        known = F.array(*[F.lit(a) for a in aliases])
        ranked = F.transform(names, lambda n, at: F.struct(F.array_position(known, n).alias("rank"), (-at).alias("less")))
        return F.transform(F.array_sort(F.filter(ranked, lambda r: r["rank"] > 0)), lambda r: -r["less"])

    return F.struct(*[of(aliases).alias(t) for t, aliases in fixed.CANONICAL_ALIASES.items()])


def _first_filled(cells: Column, places: Column) -> Column:
    """The first cell, by places, that is not empty. A field mostly has one place at most."""
    def cell(at: Column) -> Column:
        return F.nullif(F.get(cells, at), F.lit(""))

    later = F.get(F.filter(F.transform(places, cell), lambda c: c.isNotNull()), F.lit(0))
    return F.coalesce(cell(F.get(places, F.lit(0))), F.when(F.size(places) > 1, later))


def normalize_cells(rows: DataFrame, log_type: str) -> DataFrame:
    """Rows of a table whose columns are known per file -> events with generic flags.

    Expects ``source_file, seq, raw, keys, cells, places``; ``places`` are those of
    :func:`alias_places`, so no row looks its column names up again.
    """
    return _typed(rows.select(
        "source_file", "seq", "raw",
        F.map_from_arrays(F.col("keys"), F.slice("cells", F.lit(1), F.size("keys"))).alias("fields"),
        *[_first_filled(F.col("cells"), F.col("places")[t]).alias(t) for t in fixed.CANONICAL_ALIASES],
    ), log_type)


def normalize(records: DataFrame, log_type: str) -> DataFrame:
    """Records with ordered ``entries`` (key, name, value) -> events with generic flags;
    ``name`` is the cleaned key, ``at`` the place of the entry that fills each canonical field.

    Expects ``source_file, seq, raw, entries, at``.
    """
    entry = {t: F.get(F.col("entries"), F.get(F.col("at"), F.lit(n))) for n, t in enumerate(fixed.CANONICAL_ALIASES)}
    return _typed(records.select(
        "source_file", "seq", "raw",
        F.map_from_arrays("entries.key", "entries.value").alias("fields"),
        *[e["value"].alias(t) for t, e in entry.items()],
    ), log_type)


def _typed(named: DataFrame, log_type: str) -> DataFrame:
    typed = named.withColumns({
        "event_id_raw": F.col("event_id"),
        "event_id": text.first_integer(F.col("event_id")),
        "status_code": text.first_integer(F.col("status_code")),
        "event_ts": F.try_to_timestamp(F.col("timestamp")),
    })
    return to_events(flags.with_generic_flags(typed), log_type=F.lit(log_type))
