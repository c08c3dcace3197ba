"""repeatable train/test assignment from a hash of the row key.

``randomSplit`` depends on partitioning and ordering; a key hash does not,
so the same listing lands in the same split on any cluster and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """First 32 bits of md5(key as text), modulo ``buckets``."""
    return F.conv(F.substr(F.md5(key.cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long") % buckets


def is_train(key: Column, train_tenths: int = 8) -> Column:
    """True for about ``train_tenths``/10 of keys (8 → an 80/20 split)."""
    return hash_bucket(key, 10) < train_tenths
