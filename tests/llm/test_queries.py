"""The registered corpus queries over the driver's tables, and the pipeline."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rentlens.llm import common
from rentlens.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.test_pairs import corpus, frame
from tests.llm.test_text_ops import reference_base, rule_of
from tests.oracle_check import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF_CHECK, QUERIES[name], ORACLES[name])
    assert r["rows_match"] and r["schema_match"] and r["hash_match"] and r["dtype_match"], r


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_bpe_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in common.documents(spark, SF_SMALL).collect()}
    got = QUERIES["op2_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))


def test_packing_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = common.documents(spark, SF_SMALL).collect()
    got = QUERIES["op5_best_fit_packing"](spark, SF_SMALL).toPandas()
    total = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs)
    assert got.length.sum() == total and got.sequence_id.nunique() <= -(-total // 4096) + 1
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_secret_query(spark):
    docs = {r.doc_id: r.text or "" for r in common.documents(spark, SF_CHECK).collect()}
    got = QUERIES["op6_secret_scan"](spark, SF_CHECK).collect()
    assert len(got) == len(docs)
    for r in got:
        base = reference_base(docs[r.doc_id])
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert r.base_sha256 == sha(base.encode())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_url_query(spark):
    pages = {r.page_id: r.url for r in common.table(spark, SF_CHECK, "pages").collect()}
    got = QUERIES["op9_url_filter"](spark, SF_CHECK).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = rule_of(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_quality_query(spark):
    got = QUERIES["op8_quality_classifier"](spark, SF_CHECK)
    assert got.count() == common.documents(spark, SF_CHECK).count() and got.where("perplexity is null or perplexity < 1").isEmpty()


def test_language_query(spark):
    got = QUERIES["op10_language_id"](spark, SF_CHECK)
    assert got.count() == common.table(spark, SF_CHECK, "pages").count()
    assert got.where("probability < 0 or probability > 1 or lang is null").isEmpty()


def test_pipeline_over_documents(spark):
    before = common.documents(spark, SF_CHECK)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "secrets", "packing"]
    docs, counts = before, [before.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF_CHECK), "test-stage")
        if name != "packing":
            assert docs.dtypes == before.dtypes
            counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3] == counts[4] > 0
    assert corpus_pipeline.run(spark, SF_CHECK).select("doc_id").distinct().count() == counts[4]


def test_near_duplicate_stage_equals_brute_force(spark):
    rows = corpus(seed=12, n=40)
    _, low = brute.jaccard_components(rows, 5, 80)
    docs = frame(spark, rows + rows[:3]).unionByName(frame(spark, [(None, "a b"), (None, "a b")]))
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF_SMALL).collect()]
    assert sorted(got, key=str) == sorted([d for d, c in low.items() if d == c] + [None, None], key=str)


def test_passage_and_secret_stages_equal_brute_force(spark):
    rows = corpus(seed=13, n=40)
    rows = [(d, t if d % 5 else f"{t or ''} password=b7db7aa4a5fcc78305 end") for d, t in rows]
    want = brute.cut(rows, 50)
    cut = corpus_pipeline.repeated_passages(spark, frame(spark, rows), SF_SMALL)
    texts = dict(rows)
    kept = {d: (" ".join(k) if len(k) < len(w) else texts[d]) for d, (w, k) in want.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {d: (t, None if t is None else len(t)) for d, t in kept.items()}
    clean = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, cut, SF_SMALL).collect()}
    for d, t in kept.items():
        if t and reference_base(t):
            assert "b7db7aa4" not in clean[d] and "[secret]" in clean[d]
        elif t:
            assert clean[d] == t


def test_stages_take_odd_and_empty_tables(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "x"), (2, ""), (3, "a b c")]).withColumn("spans", F.lit("clash")).withColumn("N_WORDS", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_SMALL).count() >= 3
        assert stage(spark, docs.where("false"), SF_SMALL).count() == 0
