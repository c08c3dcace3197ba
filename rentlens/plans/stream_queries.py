"""Streaming queries (T1-T3); each runs its stream to completion over the
data available now and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.operators.clean import SOURCES
from rentlens.plans.common import raw
from rentlens.plans.io_queries import by_version, write_versions
from rentlens.plans.listing_queries import PERMISSIVE_CTE
from rentlens.plans.model_queries import SPLIT_CTE, RECORD_SQL, champion, scoring_records
from rentlens.plans.registry import query
from rentlens.plans.sql import ODD_CTE, with_listings
from rentlens.session import scratch_path
from rentlens.sources.files import write_csv
from rentlens.sources.tables import RAW_ORDER, odd_listings
from rentlens.streaming.ingest import ingest_listings, ingest_with_rejects
from rentlens.streaming.metrics import daily_metrics
from rentlens.streaming.runner import newest, run_available_now, run_updates
from rentlens.streaming.scoring import score_stream


@query("stream_clean_listings", with_listings("SELECT * FROM clean_listings"))
def q_stream_clean_listings(spark, sf_dir):
    """Two landings with a restart in between: the second run resumes from the
    checkpoint and cleans only the new files; the sink equals the batch result."""
    landing, out, ck = (scratch_path(spark, n) for n in ("landing", "stream-clean", "stream-clean-ck"))
    df = raw(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    write_csv(df.where(F.col("scraped_at") < cut), landing, mode="overwrite")
    ingest_listings(spark, landing, out, ck)
    write_csv(df.where(F.col("scraped_at") >= cut), landing, mode="append")
    ingest_listings(spark, landing, out, ck)
    return spark.read.parquet(out)


# odd listings as the files of three scraper versions have them, their permissive clean, and each row's reasons
_LANDED = (ODD_CTE + ",\nlanded AS (SELECT " + ", ".join(by_version(c) for c in RAW_ORDER) + " FROM odd_listings),\n"
           + PERMISSIVE_CTE.replace("FROM odd_listings WHERE sqr_m IS NOT NULL", "FROM landed")
           + ",\njudged AS (SELECT p.*, concat_ws(',', " + ", ".join(
               f"CASE WHEN p.{c} IS NULL AND {'true' if c == 'sqr_m' else f'r.{src} IS NOT NULL'} THEN '{c}' END" for c, src in SOURCES.items())
           + ") AS reasons FROM permissive p JOIN landed r ON p.listing_id = r.listing_id)")


def _ingested(spark, sf_dir):
    """(good, rejects): odd listings in files of three headers, landed in two runs."""
    landing, good, rejects, ck = (scratch_path(spark, n) for n in ("odd-landing", "good", "rejects", "odd-ck"))
    df = odd_listings(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    for some in (df.where(F.col("scraped_at") < cut), df.where(F.col("scraped_at") >= cut)):
        write_versions(some, landing)
        ingest_with_rejects(spark, landing, good, rejects, ck)
    return spark.read.parquet(good).drop("batch"), spark.read.parquet(rejects).drop("batch")


@query("stream_ingest_good", with_listings("SELECT * EXCLUDE (reasons) FROM judged WHERE reasons = ''", _LANDED))
def q_stream_ingest_good(spark, sf_dir):
    """The listings that parse, whatever their file's header."""
    return _ingested(spark, sf_dir)[0]


@query("stream_ingest_rejects", with_listings("SELECT listing_id, reasons FROM judged WHERE reasons <> ''", _LANDED))
def q_stream_ingest_rejects(spark, sf_dir):
    """The others, with the fields that do not parse."""
    return _ingested(spark, sf_dir)[1].select("listing_id", F.array_join("reasons", ",").alias("reasons"))


_METRICS = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS chunk, event_type, count(*) AS n,
       round(sum(value), 4) AS value_sum, round(avg(value), 8) AS value_avg
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1) e
"""


def _event_stream(spark, sf_dir):
    base = f"{sf_dir.rstrip('/')}"
    schema = spark.read.parquet(f"{base}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{base}/event[s].parquet")


def _rounded(r):
    return r.select("chunk", "event_type", "n", F.round("value_sum", 4).alias("value_sum"), F.round("value_avg", 8).alias("value_avg"))


@query("stream_daily_metrics", _METRICS + """
WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
GROUP BY 1, 2""")
def q_stream_daily_metrics(spark, sf_dir):
    """Events as a file stream; only days closed by the one-day watermark are emitted (append)."""
    out, ck = scratch_path(spark, "stream-metrics"), scratch_path(spark, "stream-metrics-ck")
    run_available_now(daily_metrics(_event_stream(spark, sf_dir), "ts", "value", "event_id", group="event_type"), out, ck)
    return _rounded(spark.read.parquet(out))


@query("stream_daily_metrics_all", _METRICS + "GROUP BY 1, 2")
def q_stream_daily_metrics_all(spark, sf_dir):
    """All days, open ones included: each batch updates the days it changes, the newest version of a day counts."""
    out, ck = scratch_path(spark, "stream-days"), scratch_path(spark, "stream-days-ck")
    run_updates(daily_metrics(_event_stream(spark, sf_dir), "ts", "value", "event_id", group="event_type"), out, ck)
    return _rounded(newest(spark.read.parquet(out), ["chunk", "event_type"]))


@query("stream_score", with_listings(
    "SELECT listing_id, round(predicted, 4) AS prediction FROM scored WHERE split = 'test'", SPLIT_CTE + ",\n" + RECORD_SQL))
def q_stream_score(spark, sf_dir):
    """Scoring records land as parquet files; the champion scores the stream, one row for each record."""
    landing, out, ck = (scratch_path(spark, n) for n in ("score-landing", "stream-score", "stream-score-ck"))
    records = scoring_records(spark, sf_dir)
    records.write.mode("overwrite").parquet(landing)
    stream = spark.readStream.schema(records.schema).parquet(landing)
    run_available_now(score_stream(champion(spark, sf_dir), stream), out, ck)
    return spark.read.parquet(out).select("listing_id", F.round("prediction", 4).alias("prediction"))
