"""A corpus pipeline over ``documents``: five stages, each calling one operator of ``rentlens.llm``.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and reread
as the next one's docs.  The first four return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm.common import documents, table, written
from rentlens.llm.ngram_join import ngram_jaccard_join
from rentlens.llm.packing import best_fit_packing
from rentlens.llm.quality import apply_verdicts, quality_classifier
from rentlens.llm.secrets import redacted, secret_scan
from rentlens.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return apply_verdicts(docs, quality_classifier(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the smallest doc_id.

    Rows without a doc_id cannot be told apart and stay; repeated rows of a doc_id become one.
    """
    kept = ngram_jaccard_join(docs, n=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.hint("merge").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 or more words that an earlier document has."""
    cut = substring_dedup(folded(docs), window=50)
    return unfolded(cut, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by a mark."""
    return unfolded(redacted(secret_scan(folded(docs))), F.col("text"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that none of their names meets those an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]).alias("others"))


def unfolded(df: DataFrame, text, names: list[str]) -> DataFrame:
    """The columns ``names`` again, with a new ``text`` and its number of characters."""
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col("others").getField(c)).alias(c) for c in names])


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("secrets", secrets), ("packing", packing)]

#: The stages hold trained models, tokenizers and a packing, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
