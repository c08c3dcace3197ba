"""CSV scans and sinks, dated partitioned exports.

``scan_csv`` binds columns by position and refuses a file whose header differs from
the schema; ``scan_csv_by_name`` stacks files whose headers differ.  CSV options that make write → read exact: the writer must not trim
whitespace (it would drop the newlines inside storey text) and quoted
fields may span lines, so the reader needs ``multiLine``.  A multi-line
CSV file is not splittable: land many small files, convert to parquet.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_WRITE_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
                     "ignoreTrailingWhiteSpace": "false"}
CSV_READ_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"'}
#: Without it Spark would bind columns by position whatever the header says.
CHECK_HEADER = {"enforceSchema": "false"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: headered CSV, no row-number column."""
    df.write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType,
             glob: str | None = None) -> DataFrame:
    """Headered CSV with quoted newlines; a directory is scanned whole,
    ``glob`` keeps matching file names only (e.g. ``*.csv``).  A file with another header fails."""
    reader = spark.read.schema(schema).options(**CSV_READ_OPTIONS, **CHECK_HEADER)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path)


def file_headers(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(file, header): the first line of every file that has one.

    Only the first split of a file counts, and of its lines the first that the task read.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path if isinstance(path, str) else list(path)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    numbered = lines.where("start = 0").withColumn("line", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.min_by("value", "line").alias("header"))


def header_names(line: str) -> list[str]:
    """Column names of a header line: repeated ones are numbered, blank ones called by their place."""
    fields = next(csv.reader([line.lstrip("\ufeff").rstrip("\r")], strict=True), [])
    out: list[str] = []
    for i, name in enumerate(fields):
        name, n = name or f"Unnamed: {i}", 0
        while (f"{name}.{n}" if n else name).lower() in map(str.lower, out):
            n += 1
        out.append(f"{name}.{n}" if n else name)
    return out


def scan_csv_by_name(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, glob: str | None = None,
                     extras: bool = False, bad_rows: str | None = None) -> DataFrame:
    """Headered CSV files whose columns differ in order and number, stacked by name.

    The columns of ``schema``, null where a file has none of that name (names are compared
    without regard to case); with ``extras`` the files' other columns too, as text, in the order
    in which the headers, sorted, first name them.  A row that does not fit its file's header or
    the types is kept with what could be read; ``bad_rows`` names a column for its text.

    Files are grouped by header, one scan a group.  The driver holds the files' paths, as Spark's
    own file listing does, and one line for each different header.  A header is one line; files
    without any line are left out, and without files the result is empty.
    """
    groups: dict[str, list[str]] = {}
    for r in file_headers(spark, path, glob).toLocalIterator():
        # what reads like a pattern in a name is meant as it is
        groups.setdefault(r.header, []).append(re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(r.file)))
    wanted = {f.name.lower(): f for f in schema.fields}
    marks = [T.StructField(bad_rows, T.StringType())] if bad_rows else []
    out = spark.createDataFrame([], T.StructType([*schema.fields, *marks]))
    for header in sorted(groups):
        names = header_names(header)
        fields = [wanted.get(n.lower(), T.StructField(n, T.StringType())) for n in names]
        reader = spark.read.schema(T.StructType([*fields, *marks])).options(**CSV_READ_OPTIONS)
        if bad_rows:
            reader = reader.option("columnNameOfCorruptRecord", bad_rows)
        part = reader.csv(sorted(groups[header]))
        keep = [f.name for f in fields if extras or f.name.lower() in wanted] + [m.name for m in marks]
        out = out.unionByName(part.select(*[F.col(f"`{c}`") for c in keep]), allowMissingColumns=True)
    return out


def write_dated(df: DataFrame, path: str, ts_col: str, date_col: str = "scrape_date",
                fmt: str = "parquet", max_records_per_file: int = 5_000_000) -> None:
    """K2: dated export, one folder per day, dynamic partition overwrite.

    Only the days present in ``df`` are replaced.  The rebalance hint hashes
    rows by day but lets AQE split a hot day over several tasks and merge
    small ones, so there is neither one file per task per day nor one task
    for a day holding a third of the rows.
    """
    out = df.withColumn(date_col, F.to_date(F.col(ts_col))).hint("rebalance", date_col)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(date_col).format(fmt).save(path))


# Fixed value: what follows the page number in a listing site's URL.
URL_SUFFIX = "&ref_=adv_nxt"


def page_url_frontier(seeds: DataFrame, url_col: str, start: int, stop: int, step: int,
                      suffix: str = URL_SUFFIX, keep: list[str] | None = None) -> DataFrame:
    """S3: one URL per page number in ``range(start, stop, step)`` (half-open) per seed."""
    last = start + (stop - start - 1) // step * step  # the last number before ``stop``
    none = (last < start) if step > 0 else (last > start)
    numbers = F.sequence(F.lit(start), F.lit(start if none else last), F.lit(step))
    return (seeds.where(F.lit(not none)).select(*(keep or []), url_col, F.explode(numbers).alias("page_no"))
                 .select(*(keep or []), "page_no",
                         F.concat(F.col(url_col), F.col("page_no").cast("string"), F.lit(suffix)).alias("page_url")))
