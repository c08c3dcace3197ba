"""Projections, null handling, value replacement, casts, stacking, profiling.

P1-P8 and U1-U4: narrow transformations that fuse into one codegen stage,
except ``distinct_values`` (one shuffle after a partial distinct on each
partition) and ``profile_columns`` (one global partial aggregate).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_columns(df: DataFrame, cols: list[str], strict: bool = False) -> DataFrame:
    """Drop columns; ``strict`` raises on an absent column like pandas does."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Column subset in the given order."""
    return df.select(*cols)


NON_WORD = re.compile(r"[^A-Za-z0-9_]+")


def sanitize_column_names(df: DataFrame) -> DataFrame:
    """Remove every run of characters outside [A-Za-z0-9_] from column names."""
    new = [NON_WORD.sub("", c) for c in df.columns]
    dupes = sorted({c for c in new if new.count(c) > 1})
    if dupes or "" in new:
        raise ValueError(f"sanitised names collide or are empty: {dupes or ['']}")
    return df.toDF(*new)


def filter_not_null(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows where any of ``subset`` is null."""
    return df.dropna(how="any", subset=subset)


def fill_null_columns(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """P5: per-column constant for nulls."""
    return df.fillna(values)


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def replace_values(df: DataFrame, mapping: dict[str, str], subset: list[str] | None = None) -> DataFrame:
    """Whole-value replacement in text columns (``'-'`` → ``'0'`` …)."""
    return df.replace(mapping, subset=subset or _string_columns(df))


def replace_in_strings(df: DataFrame, search: str, repl: str, regex: bool = False) -> DataFrame:
    """Substring replacement over every text column; literal unless ``regex``."""
    strings = set(_string_columns(df))

    def fix(c: str):
        col = F.col(f"`{c}`")
        if c not in strings:
            return col
        out = F.regexp_replace(col, search, repl) if regex else F.replace(col, F.lit(search), F.lit(repl))
        return out.alias(c)

    return df.select(*[fix(c) for c in df.columns])


def cast_columns(df: DataFrame, types: dict[str, str], mode: str = "fail") -> DataFrame:
    """Casts; ``fail`` follows ANSI (bad text raises), ``permissive`` gives null.

    double → int truncates toward zero, as ``astype(int)`` does; nulls stay null.
    """
    def cast(c: str):
        col = F.col(f"`{c}`")
        if c not in types:
            return col
        return (col.try_cast(types[c]) if mode == "permissive" else col.cast(types[c])).alias(c)

    return df.select(*[cast(c) for c in df.columns])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; missing columns are null, duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column, null included (unordered)."""
    return df.select(col).distinct()


def distinct_in_order(files: DataFrame, value: Column) -> DataFrame:
    """U2 as a list is read: each distinct value (null included) with the place where it comes first, in that order.

    ``files`` is a scan of Parquet files, whose hidden columns name file and row; files come in the order of their
    paths.  One grouped minimum, combined before the exchange; only the distinct values are sorted.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = files.select(value.alias("value"), place.alias("place")).groupBy("value").agg(F.min("place").alias("place"))
    return first.orderBy("place").select("value", F.col("place.file").alias("first_file"), F.col("place.row").alias("first_row"))


def head_rows(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First n rows in key order (a global top-n, partial per partition)."""
    return df.orderBy(*(order_by or [df.columns[0]])).limit(n)


def profile_columns(df: DataFrame) -> DataFrame:
    """U4: per column its name, type and non-null count, from one aggregate pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = ", ".join(f"'{c}', '{df.schema[c].dataType.simpleString()}', c{i}"
                     for i, c in enumerate(df.columns))
    return counts.selectExpr(
        f"stack({len(df.columns)}, {rows}) AS (column_name, dtype, non_null)")
