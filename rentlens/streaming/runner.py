"""Run a streaming DataFrame to completion over the data available now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_available_now(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet") -> None:
    q = (stream.writeStream.format(fmt).outputMode(mode)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start(out))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Update mode into a table of versions: each batch writes its changed rows to a folder of its own.

    A batch that is run again after a failure overwrites its folder, so every version is there once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(stream, write, checkpoint, "update")


def run_batches(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """``batch(rows, number)`` for each batch of the data available now; one that failed runs again with its number and rows."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def newest(versions: DataFrame, keys: list[str], by: str = "batch") -> DataFrame:
    """The newest version of each key of a table written by ``run_updates``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return versions.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", by)
