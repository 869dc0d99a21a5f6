"""Stages of the pipeline: what stays, and that labelled good documents do."""

import numpy as np

import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    left = docs
    for name, stage in cp.STAGES[:-1]:
        left = cp.saved(stage(spark, left, SF), "stage")
        assert left.columns == docs.columns
        now = {r.doc_id: r for r in left.collect()}
        assert set(now) <= set(before) and all(r.n_chars == len(r.text) for r in now.values())
        if name.startswith("quality"):
            long = {i for i in good & set(before) if len(before[i].text.split()) >= 20}
            assert len(long - set(now)) <= 0.02 * len(long)
        before = now
    pieces = cp.pack(spark, left, SF).collect()
    assert sum(r.length for r in pieces) == sum({(r.doc_id): r.doc_tokens for r in pieces}.values())
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in pieces)


def test_stages_on_edge_documents(spark, docs, no_docs):
    for table in (docs.select("doc_id", "text", "lang", "score"), no_docs.select("doc_id", "text", "lang", "score")):
        for _, stage in cp.STAGES:
            stage(spark, table, SF).count()
