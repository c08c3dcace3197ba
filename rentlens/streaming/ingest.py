"""Newly landed listing CSV files → the same clean step as batch → parquet.

``ingest_listings`` takes files of one header and refuses others.  ``ingest_with_rejects``
takes files of any header and answers for every row: it is either in the table of
good listings or in that of rejects, with the reasons.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.operators.clean import clean_listings, judged_listings
from rentlens.schema import KEYED_RAW_SCHEMA
from rentlens.sources.files import CHECK_HEADER, CSV_READ_OPTIONS, scan_csv_by_name
from rentlens.streaming.runner import run_available_now, run_batches

#: Reasons of a reject beside the names of fields that did not parse.
MALFORMED, NO_KEY = "malformed row", "listing_id"


def listing_stream(spark: SparkSession, landing: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Files with the header of ``KEYED_RAW_SCHEMA``; any other fails the stream."""
    return (spark.readStream.schema(KEYED_RAW_SCHEMA).options(**CSV_READ_OPTIONS, **CHECK_HEADER)
                 .option("maxFilesPerTrigger", max_files_per_trigger)
                 .option("pathGlobFilter", "*.csv").csv(landing))


def ingest_listings(spark: SparkSession, landing: str, out: str, checkpoint: str, mode: str = "fail") -> None:
    """Process every file landed since the last run (stateless, exactly once)."""
    run_available_now(clean_listings(listing_stream(spark, landing), mode), out, checkpoint)


def landed_files(spark: SparkSession, landing: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The paths of newly landed CSV files as a stream; their content is not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (spark.readStream.schema(schema).format("binaryFile").option("maxFilesPerTrigger", max_files_per_trigger)
                 .option("pathGlobFilter", "*.csv").load(landing).select("path"))


def judged_records(raw: DataFrame, bad_rows: str) -> DataFrame:
    """Text records → cleaned columns, ``rejected`` (reasons) and ``record`` (the text as read)."""
    texts = [c for c in raw.columns if c != bad_rows]
    record = F.coalesce(F.col(bad_rows), F.to_json(F.struct(*texts)))
    keyed = raw.select(*texts, F.col(bad_rows).isNotNull().alias("_malformed"), record.alias("record"))
    typed = keyed.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in KEYED_RAW_SCHEMA if not isinstance(f.dataType, T.StringType)})
    judged = judged_listings(typed)
    more = F.filter(F.array(F.when(F.col("_malformed"), F.lit(MALFORMED)), F.when(F.col("listing_id").isNull(), F.lit(NO_KEY))), lambda x: x.isNotNull())
    return judged.withColumn("rejected", F.concat(more, "rejected")).drop("_malformed")


def ingest_with_rejects(spark: SparkSession, landing: str, good: str, rejects: str, checkpoint: str,
                        max_files_per_trigger: int = 1000) -> None:
    """Every file landed since the last run, columns by name, into ``good`` (clean schema) and ``rejects`` (listing_id, reasons, record).

    Each batch writes a folder of its own in both tables; a batch that is run again after a failure
    overwrites its folders, so good and rejected rows are together the rows landed, each once.
    A row is rejected if it does not fit its file's header, has no listing_id or area, or holds a
    field that does not parse.
    """
    bad_rows = "_malformed_text"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in KEYED_RAW_SCHEMA])

    def land(batch: DataFrame, number: int) -> None:
        files = [r.path for r in batch.collect()]  # at most max_files_per_trigger
        if not files:
            return
        judged = judged_records(scan_csv_by_name(batch.sparkSession, files, text, bad_rows=bad_rows), bad_rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fine = F.size("rejected") == 0
            judged.where(fine).drop("rejected", "record").write.mode("overwrite").parquet(f"{good}/batch={number}")
            (judged.where(~fine).select("listing_id", F.col("rejected").alias("reasons"), "record")
                   .write.mode("overwrite").parquet(f"{rejects}/batch={number}"))
        finally:
            judged.unpersist()

    run_batches(landed_files(spark, landing, max_files_per_trigger), land, checkpoint)
