"""Daily chunk metrics over an event stream, with a late-data bound.

Event time must be a TIMESTAMP for a watermark; TIMESTAMP_NTZ columns are
read as UTC wall time without going through the session time zone.  Duplicates of a
key are dropped while within the watermark; a day is emitted once the
watermark passes its end (append mode), so late rows beyond the bound are
not counted and state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ntz_as_utc(c: Column) -> Column:
    """TIMESTAMP_NTZ wall time read as UTC, independent of the session time zone."""
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    whole = days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return F.timestamp_micros(whole * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long"))


def utc_day(c: Column) -> Column:
    """Calendar day (UTC) of a TIMESTAMP as 'yyyy-MM-dd', independent of the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int")).cast("string")


def daily_metrics(stream: DataFrame, ts: str, value: str, key: str, group: str | None = None,
                  delay: str = "1 day") -> DataFrame:
    t = F.col(ts)
    as_instant = ntz_as_utc(t) if isinstance(stream.schema[ts].dataType, T.TimestampNTZType) else t
    events = (stream.withColumn(ts, as_instant)
                    .withWatermark(ts, delay)
                    .dropDuplicatesWithinWatermark([key]))
    keys = [F.window(F.col(ts), "1 day").alias("w")] + ([F.col(group)] if group else [])
    return (events.groupBy(*keys)
                  .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value_sum"),
                       F.avg(value).alias("value_avg"))
                  .select(utc_day(F.col("w.start")).alias("chunk"),
                          *([group] if group else []), "n", "value_sum", "value_avg"))
