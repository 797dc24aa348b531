"""Alert times and spans as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO text (``Z``, an offset or none), else whole epoch seconds, else null."""
    epoch = F.timestamp_seconds(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")))
    return F.when(text.rlike("^[0-9]+$"), epoch).otherwise(text.try_cast("timestamp"))


def duration_text(start_us: Column, end_us: Column) -> Column:
    """Length of a span for people: ms, s, m s, h m or d h."""
    us = end_us - start_us
    s = F.floor(us / 1_000_000)

    def part(unit: int, wrap: int | None = None) -> Column:
        n = F.floor(us / (unit * 1_000_000))
        return (n % wrap if wrap else n).cast("bigint").cast("string")

    def tenths(span: Column) -> Column:
        rounded = span + 50_000
        whole, tenth = F.floor(rounded / 1_000_000), F.floor(rounded / 100_000) % 10
        return F.concat_ws(".", whole.cast("string"), tenth.cast("string"))

    return (
        F.when(start_us.isNull() | end_us.isNull(), "Unknown duration")
        .when(us == 0, "0 seconds (simultaneous events)")
        .when(us < 0, F.concat(F.lit("Invalid duration ("), F.format_string("%.3f", us / 1e6), F.lit("s - negative)")))
        .when(s < 1, F.concat(F.floor(us / 1000).cast("string"), F.lit(" milliseconds")))
        .when(s < 60, F.concat(tenths(us), F.lit(" seconds")))
        .when(s < 3600, F.concat(part(60), F.lit("m "), part(1, 60), F.lit("s")))
        .when(s < 86400, F.concat(part(3600), F.lit("h "), part(60, 60), F.lit("m")))
        .otherwise(F.concat(part(86400), F.lit("d "), part(3600, 24), F.lit("h")))
    )
