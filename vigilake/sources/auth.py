"""System-login (syslog) lines -> events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import flags, text
from vigilake.schema import to_events
from vigilake.sources.lines import clean_lines


def auth_events(lines: DataFrame, default_year: int | None = None, log_type: str = "auth") -> DataFrame:
    """Events of ``(source_file, seq, value)`` lines.

    A line outside the layout is kept with its text as message and carries no flags.
    The layout has no year: ``default_year`` (this year if not given) dates ``event_ts``.
    """
    parts = clean_lines(lines, skip_comments=True).withColumn(
        "_p", text.once(text.captures(F.col("value"), fixed.AUTH_LINE, 7))
    )
    p = F.col("_p")
    parsed = parts.select(
        "source_file", "seq", F.col("value").alias("raw"),
        p[0].alias("month"), p[1].alias("day"), p[2].alias("time"), p[3].alias("host"),
        F.when(p.isNull(), F.lit("")).otherwise(p[4]).alias("process"),
        text.absent_if_empty(p[5]).alias("pid"),
        F.coalesce(p[6], F.col("value")).alias("message"),
    )
    matched, message = F.col("time").isNotNull(), F.col("message")
    year = F.lit(default_year).cast("string") if default_year else F.date_format(F.current_date(), "yyyy")
    fielded = parsed.withColumns({
        **{n: F.when(matched, text.first_group(message, pattern)) for n, pattern in fixed.AUTH_FIELDS.items()},
        "event_ts": F.try_to_timestamp(
            F.concat_ws(" ", year, F.col("month"), F.col("day"), F.col("time")),
            F.lit("yyyy MMM d HH:mm:ss"),
        ),
    })
    return to_events(flags.with_auth_flags(fielded), log_type=F.lit(log_type))
