"""F1 one-hot, F3 split column, F4 formula design matrix."""

from __future__ import annotations

import re

from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from rentlens.functions.split import is_train
from rentlens.session import scratch_path


def category_levels(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """Sorted non-null levels of each column from one pass over ``df``.

    (column, value) pairs are de-duplicated with a partial distinct on every
    partition; what reaches the driver is the names of the result's columns.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                               for c in cols]))
    out: dict[str, list] = {c: [] for c in cols}
    for r in df.select(pairs).where(F.col("v").isNotNull()).distinct().collect():
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_columns(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """``<col>_<level>`` int indicator for every level; null → all zeros; source column dropped."""
    keep = keep if keep is not None else [c for c in df.columns if c not in cols]
    out = [F.col(c) for c in keep]
    levels = category_levels(df, cols)
    for c in cols:
        for lvl in levels[c]:
            out.append(F.coalesce((F.col(c) == F.lit(lvl)).cast("int"), F.lit(0)).alias(f"{c}_{lvl}"))
    return df.select(*out)


def level_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, level, slot): the non-null levels of each column, numbered from 0 by column and level, as a written table.

    The numbers come from ranges of the sorted levels: each range is counted, and the counts before it are the first
    number in it.  What is in one task is a range, or a row a range; no level reaches the driver.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "levels")
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                               for i, c in enumerate(cols)]))
    levels = df.select(pairs).where("level is not null").distinct()
    levels.repartitionByRange("at", "level").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    by_part = Window.partitionBy(F.lit(0)).orderBy("part")
    firsts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(by_part) - F.col("n")).alias("first"))
    within = Window.partitionBy("part").orderBy("at", "level")
    numbered = ranged.join(firsts, "part").select("column", "level", (F.col("first") + F.row_number().over(within) - 1).cast("int").alias("slot"))
    path = scratch_path(spark, "level-slots")
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def one_hot_sparse(df: DataFrame, cols: list[str], keep: list[str] | None = None, levels: DataFrame | None = None) -> DataFrame:
    """F1 for many levels: ``slots`` (ascending numbers of the row's levels in ``levels``, by default those of ``df``) and
    ``width`` (number of levels, the same in every row).

    A null value, or one that ``levels`` lacks, has no slot, as it is all zeros in ``one_hot_columns``.  Each column is one
    left join to its part of the dictionary, which Catalyst broadcasts only where its written size allows; a
    level that many rows share is split by AQE.  Only the width reaches the driver.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in cols]
    levels = level_dictionary(df, cols) if levels is None else levels
    width = levels.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
    out = df
    for i, c in enumerate(cols):
        own = levels.where(F.col("column") == c).select(F.col("level").alias(f"__level{i}"), F.col("slot").alias(f"__slot{i}"))
        out = out.join(own, F.col(c).cast("string") == F.col(f"__level{i}"), "left")
    found = F.filter(F.array(*[F.col(f"__slot{i}") for i in range(len(cols))]), lambda s: s.isNotNull())
    return out.select(*keep, F.array_sort(found).alias("slots"), F.lit(int(width)).alias("width"))


def slot_vectors(df: DataFrame, out: str = "features") -> DataFrame:
    """``out``: ``slots`` and ``width`` as an MLlib sparse vector of ones.

    MLlib has no column function that makes one, so the vector's fields pass through JSON, all in the JVM.
    """
    fields = F.struct(F.struct(F.lit(0).alias("type"), F.col("width").alias("size"), F.col("slots").alias("indices"),
                               F.transform("slots", lambda _: F.lit(1.0)).alias("values")).alias("v"))
    return df.withColumn(out, F.from_json(F.to_json(fields), StructType([StructField("v", VectorUDT())]))["v"])


def with_split(df: DataFrame, key: str = "listing_id", train_tenths: int = 8,
               col: str = "split") -> DataFrame:
    """``split`` = 'train' / 'test' from the key hash."""
    return df.withColumn(col, F.when(is_train(F.col(key), train_tenths), "train").otherwise("test"))


#: A formula of names added up, which needs no fitted transformer.
_SUM_OF_NAMES = re.compile(r"\s*\w+\s*~\s*[A-Za-z_]\w*(\s*\+\s*[A-Za-z_]\w*)*\s*")


def formula_design_matrix(df: DataFrame, formula: str, keep: list[str] | None = None) -> DataFrame:
    """treatment-coded design matrix; the alphabetically first level is the base.

    Rows with nulls in the formula's columns are dropped first, as formula
    fitting does by default.  A sum of numeric and text columns takes one pass for the
    levels of all text columns, and its matrix is an expression; any other formula is left to
    RFormula, which makes a pass for each text column.
    """
    used = [c.strip() for c in formula.replace("~", "+").split("+") if c.strip() and c.strip() != "."]
    clean = df.dropna(subset=used)
    kinds = {c: df.schema[c].dataType for c in used if c in df.columns}
    simple = (_SUM_OF_NAMES.fullmatch(formula) and set(kinds) == set(used) and isinstance(kinds[used[0]], NumericType)
              and all(isinstance(t, (NumericType, StringType)) for t in kinds.values()))
    if simple:
        texts = [c for c in used[1:] if isinstance(kinds[c], StringType)]
        levels = category_levels(clean, texts) if texts else {}
        cells = []
        for c in used[1:]:
            cells += ([(F.col(c) == F.lit(v)).cast("double") for v in levels[c][:0:-1]] if c in levels else [F.col(c).cast("double")])
        return clean.select(*(keep or []), F.col(used[0]).cast("double").alias("label"), F.array(*cells).alias("features"))
    rf = RFormula(formula=formula, featuresCol="features", labelCol="label",
                  stringIndexerOrderType="alphabetDesc", handleInvalid="error")
    model = rf.fit(clean)
    return model.transform(clean).select(*(keep or []), "label",
                                         vector_to_array("features").alias("features"))
