"""Web access lines (combined layout) -> events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake import fixed
from vigilake.functions import flags, text
from vigilake.schema import to_events
from vigilake.sources.lines import clean_lines


def web_events(lines: DataFrame) -> DataFrame:
    """Events of ``(source_file, seq, value)`` lines; ``target`` is the request target as
    sent, ``path`` the decoded one. A line outside the layout keeps only its text."""
    parts = clean_lines(lines).withColumn(
        "_p", text.once(text.captures(F.col("value"), fixed.WEB_LINE, 10))
    )
    p = F.col("_p")
    parsed = parts.select(
        "source_file", "seq", F.col("value").alias("raw"),
        F.when(p.isNull(), F.col("value")).alias("message"),
        p[0].alias("src_ip"), p[1].alias("username"), p[2].alias("timestamp"),
        p[3].alias("method"), p[4].alias("target"), p[5].alias("protocol"),
        p[6].try_cast("int").alias("http_status"), p[7].alias("size"),
        p[8].alias("referer"), p[9].alias("useragent"),
    )
    decoded = parsed.withColumns({
        "path": text.percent_decode(F.col("target")),
        "status": F.col("http_status").cast("string"),
        "user_agent": F.col("useragent"),
        "event_ts": F.try_to_timestamp(F.col("timestamp"), F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
    })
    return to_events(flags.with_web_flags(decoded), log_type=F.lit("apache"))
