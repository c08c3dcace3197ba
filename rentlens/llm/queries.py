"""The corpus operators as registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm import sql
from rentlens.llm.bpe import bpe_decode, bpe_encode
from rentlens.llm.common import documents, table
from rentlens.llm.embedding_dedup import embedding_near_dedup
from rentlens.llm.html_extract import html_main_text
from rentlens.llm.language_id import language_id
from rentlens.llm.ngram_join import ngram_jaccard_join
from rentlens.llm.packing import best_fit_packing
from rentlens.llm.quality import quality_classifier
from rentlens.llm.secrets import secret_scan
from rentlens.llm.spelling_variants import spelling_variants
from rentlens.llm.substring_dedup import substring_dedup
from rentlens.llm.topk_search import exact_top_k
from rentlens.llm.url_filter import url_filter
from rentlens.llm.vector_codes import train_codebooks, vector_codes, with_group_error

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; without ``oracle`` it is tested against brute force."""
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


@query("op1_substring_dedup", sql.SUBSTRING_DEDUP)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens", "ids")
    return bpe_decode(coded, vocabulary).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                                F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_embedding_near_dedup", sql.EMBEDDING_NEAR_DEDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"), least=0.98)


@query("op4_exact_top_k", sql.EXACT_TOP_K)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    listed = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op7_ngram_jaccard_join", sql.NGRAM_JACCARD_JOIN)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir), n=4, percent=85)


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", "perplexity", "accepted")


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "pages"), documents(spark, sf_dir))


@query("op11_spelling_variants", sql.SPELLING_VARIANTS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), shortest=7, least=2, every=31, ratio=10)


@query("op12_vector_codes", sql.vector_codes())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train_codebooks(vectors, parts=8, entries=16, rounds=6, scale=4096)
    coded = with_group_error(vector_codes(vectors, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op13_html_main_text", sql.HTML_MAIN_TEXT)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
