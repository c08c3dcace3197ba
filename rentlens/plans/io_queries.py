"""Queries for sources, sinks and HTML extraction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.operators.extract import extract_listings, html_find_all, html_find_first
from rentlens.plans.pages import render_listing_pages
from rentlens.plans.common import listings, raw
from rentlens.plans.registry import query
from rentlens.plans.sql import with_listings
from rentlens.schema import CLEAN_COLUMNS, CLEAN_TYPES, KEYED_RAW_SCHEMA, RAW_COLUMNS
from rentlens.session import scratch_path
from rentlens.sources.files import page_url_frontier, scan_csv, scan_csv_by_name, write_csv, write_dated
from rentlens.sources.tables import read_table

CLEAN_KEYED_SCHEMA = T.StructType(
    [T.StructField("listing_id", T.LongType()), T.StructField("scraped_at", T.TimestampNTZType())]
    + [T.StructField(c, CLEAN_TYPES[c]) for c in CLEAN_COLUMNS])


def _decode(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), "
            f"'&amp;', '&')")


@query("scan_csv_multiline", with_listings("SELECT * FROM raw_listings"))
def q_scan_csv_multiline(spark, sf_dir):
    path = scratch_path(spark, "listings-csv")
    write_csv(raw(spark, sf_dir), path)
    return scan_csv(spark, path, KEYED_RAW_SCHEMA)


@query("scan_csv_directory", with_listings("SELECT * FROM raw_listings"))
def q_scan_csv_directory(spark, sf_dir):
    """Two CSV batches and a JSON copy land in one folder; only *.csv is read."""
    path = scratch_path(spark, "landing")
    df = raw(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    write_csv(df.where(F.col("scraped_at") < cut), path, mode="overwrite")
    write_csv(df.where(F.col("scraped_at") >= cut), path, mode="append")
    df.write.mode("append").json(path)
    return scan_csv(spark, path, KEYED_RAW_SCHEMA, glob="*.csv")


#: Three versions of a scraper: listings by key, the columns that each writes, in its order.
VERSIONS = [["listing_id", "scraped_at", *RAW_COLUMNS],
            [*reversed(RAW_COLUMNS), "listing_id", "scraped_at"],
            ["Lat", "floor", "listing_id", *[c for c in RAW_COLUMNS if c not in ("floor", "house_type")], "agent"]]


def write_versions(df, path: str) -> None:
    """The listings as CSV files with the headers of ``VERSIONS``, dealt by key."""
    df = df.withColumns({"Lat": F.lit("35.6"), "agent": F.concat(F.lit("a,"), F.col("listing_id") % 7)})
    for i, names in enumerate(VERSIONS):
        write_csv(df.where(F.col("listing_id") % len(VERSIONS) == i).select(*names), path, mode="append")


def by_version(column: str) -> str:
    """SQL of a column that a by-name scan of ``write_versions`` finds."""
    has = [str(i) for i, names in enumerate(VERSIONS) if column in names]
    return column if len(has) == len(VERSIONS) else f"CASE WHEN listing_id % {len(VERSIONS)} IN ({', '.join(has)}) THEN {column} END AS {column}"


@query("scan_csv_by_name", with_listings(
    "SELECT " + ", ".join(by_version(f.name) for f in KEYED_RAW_SCHEMA)
    + f", CASE WHEN listing_id % {len(VERSIONS)} = 2 THEN '35.6' END AS \"Lat\""
    + f", CASE WHEN listing_id % {len(VERSIONS)} = 2 THEN 'a,' || CAST(listing_id % 7 AS VARCHAR) END AS agent FROM raw_listings"))
def q_scan_csv_by_name(spark, sf_dir):
    """Files with reordered, missing and extra columns, stacked by name."""
    path = scratch_path(spark, "versions")
    write_versions(raw(spark, sf_dir), path)
    return scan_csv_by_name(spark, path, KEYED_RAW_SCHEMA, glob="*.csv", extras=True)


@query("sink_csv_roundtrip", with_listings("SELECT * FROM clean_listings"))
def q_sink_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "clean-csv")
    write_csv(listings(spark, sf_dir), path)
    return scan_csv(spark, path, CLEAN_KEYED_SCHEMA)


@query("sink_dated_partitions", with_listings(
    "SELECT CAST(CAST(scraped_at AS DATE) AS VARCHAR) AS scrape_date, count(*) AS listings, "
    "round(sum(rent_price), 2) AS rent_sum FROM clean_listings GROUP BY 1"))
def q_sink_dated_partitions(spark, sf_dir):
    """Write every day, then rewrite the days from 1998 on: dynamic overwrite
    replaces those days only, so the read-back still holds every listing once."""
    path = scratch_path(spark, "dated")
    df = listings(spark, sf_dir)
    write_dated(df, path, "scraped_at")
    write_dated(df.where(F.col("scraped_at") >= F.lit("1998-01-01").cast("timestamp_ntz")), path, "scraped_at")
    back = spark.read.parquet(path)
    return (back.groupBy(F.col("scrape_date").cast("string").alias("scrape_date"))
                .agg(F.count(F.lit(1)).alias("listings"), F.round(F.sum("rent_price"), 2).alias("rent_sum")))


@query("page_url_frontier", """
SELECT page_id, CAST(p AS INTEGER) AS page_no, url || CAST(p AS VARCHAR) || '&ref_=adv_nxt' AS page_url
FROM pages, range(0, 50, 3) t(p)""")
def q_page_url_frontier(spark, sf_dir):
    return page_url_frontier(read_table(spark, sf_dir, "pages"), "url", 0, 50, 3, keep=["page_id"])


@query("html_find_all", f"""
SELECT page_id, CAST(position AS INTEGER) AS position, {_decode('href')} AS href, {_decode('text')} AS text
FROM (SELECT page_id,
        unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
        unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
        unnest(range(1, len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) + 1)) AS position
      FROM pages) t""")
def q_html_find_all(spark, sf_dir):
    return html_find_all(read_table(spark, sf_dir, "pages"), "html", "a", attrs=("href",), keep=["page_id"])


@query("html_find_first", f"""
SELECT page_id,
 CASE WHEN regexp_matches(html, '<title>[^<]*</title>')
      THEN {_decode("regexp_extract(html, '<title>([^<]*)</title>', 1)")} END AS title,
 CASE WHEN regexp_matches(html, '<h1>[^<]*</h1>')
      THEN {_decode("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} END AS h1
FROM pages""")
def q_html_find_first(spark, sf_dir):
    return html_find_first(read_table(spark, sf_dir, "pages"), "html",
                           {"title": [("title", None)], "h1": [("h1", None)]}, keep=["page_id"])


@query("html_extract_listings", with_listings(
    "SELECT listing_id, " + ", ".join(RAW_COLUMNS) + " FROM raw_listings"))
def q_html_extract_listings(spark, sf_dir):
    pages = render_listing_pages(raw(spark, sf_dir), per_page=20)
    return extract_listings(pages).select("listing_id", *RAW_COLUMNS)
