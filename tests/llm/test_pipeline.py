"""The pipeline, stage by stage, on the smallest tables."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siteloom.llm import quality
from test_minhash import brute as components
from test_repeats import brute as covered

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        results[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = results["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [labels[r.doc_id] == (r.doc_id in after) for r in before if r.doc_id in labels]
    assert sum(kept) / len(kept) > 0.95

    before, after = results["minhash_near_dedup"]
    assert set(after) == {i for i, (_, c) in components([(r.doc_id, r.text) for r in before], 5, 80, 100).items() if i == c}

    before, after = results["suffix_array_dedup"]
    gone = covered(sorted((r.doc_id, r.text) for r in before))
    for r in before:
        left = bytes(c for c, g in zip(r.text.encode(), gone[r.doc_id]) if not g)
        assert after[r.doc_id].text == left.decode("utf-8", "ignore") or len(after[r.doc_id].text.encode()) - len(left) in range(0, 8)
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)

    before, after = results["benchmark_decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in before:
        if any(i in r.text for i in items):
            assert r.doc_id not in after
    assert len(after) > 0.9 * len(before)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    for i, r in after.items():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert (last[i].n_tokens, last[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_and_empty_documents(spark):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(ids) < 200
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame([], docs.schema)


def test_awkward_rows_pass_every_stage(spark, docs):
    df = docs.withColumnRenamed("sig", "source").selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(NULL AS LONG) AS n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = df
        df = spark.createDataFrame(stage(spark, df, SF).collect(), stage(spark, df, SF).schema)
        assert df.count() <= before.count(), name
    assert isinstance(quality.held_out("doc_id"), object)
