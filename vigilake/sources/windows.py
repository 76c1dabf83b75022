"""Windows security-log text exports -> events: one line per event, or key/value blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import flags, text
from vigilake.schema import to_events
from vigilake.sources.lines import clean_lines, spaced


def _event_ts(stamp):
    """12-hour form first, then 24-hour form."""
    return F.coalesce(
        F.try_to_timestamp(stamp, F.lit("M/d/yyyy h:mm:ss a")),
        F.try_to_timestamp(stamp, F.lit("M/d/yyyy H:mm:ss")),
    )


def win_tabular_events(lines: DataFrame) -> DataFrame:
    """Events of tabular lines; a line that at least names an event id is kept whole, any
    other line outside the layout is dropped."""
    parts = clean_lines(lines, skip_comments=True).withColumn(
        "_p", text.once(text.captures(F.col("value"), fixed.WIN_LINE, 6))
    ).withColumn(
        "_loose", F.when(F.col("_p").isNull(), text.first_group(F.col("value"), fixed.WIN_LOOSE_EVENT_ID))
    ).filter("_p is not null or _loose is not null")
    p = F.col("_p")
    parsed = parts.select(
        "source_file", "seq", F.col("value").alias("raw"),
        p[0].alias("date"), p[1].alias("time"), p[2].alias("source"),
        F.coalesce(p[3], F.col("_loose")).alias("event_id_raw"),
        text.strip(p[4]).alias("category"),
        F.coalesce(text.strip(p[5]), F.col("value")).alias("message"),
    ).withColumns({
        "event_id": F.col("event_id_raw").try_cast("int"),
        "event_ts": _event_ts(F.upper(F.concat_ws(" ", "date", "time"))),
    })
    return to_events(flags.with_event_id_flags(parsed), log_type=F.lit("windows"))


def cut_blocks(pieces: DataFrame) -> DataFrame:
    """Pieces of a file cut at its usual empty lines -> blocks; the other kind of line end,
    where a file mixes both, cuts inside a piece."""
    parts = spaced(pieces).select("source_file", "seq", F.posexplode(F.split("value", r"\r?\n\r?\n")).alias("at", "value"))
    return parts.select("source_file", (F.col("seq") + F.col("at")).alias("seq"), "value")


def win_block_events(blocks: DataFrame) -> DataFrame:
    """Events of key/value blocks, one block per row (text cut at empty lines)."""
    value = F.col("value")
    blocks = blocks.withColumn("value", F.btrim(value, F.lit("\r\n"))).filter(text.strip(value) != "")
    found = {n: text.strip(text.first_group(value, p)) for n, p in fixed.WIN_BLOCK_FIELDS.items()}
    parsed = (
        blocks.select(
            "source_file", "seq", value.alias("raw"),
            found.pop("event_id").alias("event_id_raw"),
            F.substring(value, 1, 200).alias("message"),
            *[c.alias(n) for n, c in found.items()],
        )
        .withColumns({
            "event_id": F.col("event_id_raw").try_cast("int"),
            "host": F.col("workstation"),
            "event_ts": _event_ts(F.upper("timestamp")),
        })
    )
    return to_events(flags.with_event_id_flags(parsed), log_type=F.lit("windows"))


def win_layout(lines: DataFrame) -> DataFrame:
    """``(source_file, layout)``: ``blocks`` where the file holds a block label anywhere."""
    return _layouts(lines).drop("crlf")


def win_files(lines: DataFrame) -> DataFrame:
    """``win_layout`` and ``crlf``: whether most lines end in a carriage return."""
    return _layouts(lines)


def _layouts(lines: DataFrame) -> DataFrame:
    labelled = text.contains_any(F.col("value"), fixed.WIN_BLOCK_MARKERS)
    return lines.groupBy("source_file").agg(
        F.when(F.bool_or(labelled), "blocks").otherwise("tabular").alias("layout"),
        (2 * F.count_if(F.col("value").endswith("\r")) > F.count(F.lit(1))).alias("crlf"),
    )
