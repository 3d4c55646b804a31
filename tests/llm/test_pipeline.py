import re

import pytest

import corpus_pipeline
from inkwell.llm.packing import pack
from inkwell.llm.pii import Finder, masked, train
from inkwell.llm.queries import BYTE_BPE
from inkwell.llm._text import text_bytes
from tests.llm.test_jaccard_join import brute

import pyarrow as pa


def test_stages_have_the_order_and_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "pii", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), small).dtypes == docs.dtypes


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    accepted = {r.doc_id for r in corpus_pipeline.language(spark, docs, folder).collect()}
    assert accepted >= {i for i, t in texts.items() if re.search(r"[^\W\d_]{3}", t)} or len(accepted) > 0.97 * len(texts)
    lowered = {}
    for i in sorted(accepted):
        lowered["".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])] = i
    unique = sorted(lowered.values())
    linked = brute([(i, texts[i]) for i in unique], 5, 4, 5)
    left = [i for i in unique if linked[i][1] == i]
    spans = Finder(train()).spans(*text_bytes(pa.array([texts[i] for i in left])))
    clean = [(i, masked(texts[i], s)) for i, s in zip(left, spans, strict=True)]
    expected = pack(spark.createDataFrame(clean, "doc_id long, text string"), BYTE_BPE).select("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_and_odd_documents(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "s", 0), (None, "hello there all of you", "en", "s", 5), (3, "write to a@b.cc today", "en", None, 9)], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, small)
        assert stage(spark, odd.limit(0), small).count() == 0
        if name == "pii":
            assert {r.doc_id: r.text for r in out.collect()}[3] == "write to [EMAIL] today"
        assert out.count() >= 1
