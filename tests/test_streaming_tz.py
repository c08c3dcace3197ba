"""The streaming day metrics do not depend on the session time zone."""

from pyspark.sql import functions as F

from rentlens.streaming.metrics import ntz_as_utc, utc_day


def test_ntz_as_utc_is_session_tz_independent(spark):
    df = spark.createDataFrame([("2024-01-07 23:30:00.250000",)], "s string") \
              .select(F.col("s").cast("timestamp_ntz").alias("t"))
    old = spark.conf.get("spark.sql.session.timeZone")
    out = []
    try:
        for tz in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = df.select(F.unix_micros(ntz_as_utc(F.col("t"))).alias("u"), utc_day(ntz_as_utc(F.col("t"))).alias("d")).first()
            out.append((r["u"], r["d"]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(set(out)) == 1
    assert out[0] == (1704670200250000, "2024-01-07")
