"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomstar.llm import common, packing, quality_fm, toxicity_mil
from loomstar.llm.queries import QUALITY_METADATA, THRESHOLD
from tests.llm.test_operators import brute_decontamination, brute_near_duplicates, edge, empty  # noqa: F401


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "benchmark_passages", "packing"]
    labels, columns, out = common.table(spark, sf_dir, "labels"), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out[name] = docs, common.written(stage(spark, docs, sf_dir), name)
        docs = out[name][1]
        assert docs.columns == columns
    before, after = out["toxicity"]
    model = toxicity_mil.fit(before, labels, common.fold(F.col("doc_id"), 4) != 2)
    assert {r["doc_id"] for r in toxicity_mil.score(before, model).where(F.col("score") < THRESHOLD).collect()} == {i for i, _ in texts(after)}
    before, after = out["quality"]
    model = quality_fm.fit(before, labels, common.fold(F.col("doc_id"), 5) != 0, metadata=QUALITY_METADATA)
    assert {r["doc_id"] for r in quality_fm.score(before, model, QUALITY_METADATA).where(F.col("score") >= THRESHOLD).collect()} == {i for i, _ in texts(after)}
    before, after = out["near_duplicates"]
    assert {i for i, _ in texts(after)} == {r[0] for r in brute_near_duplicates(texts(before), 5) if r[3]}
    before, after = out["benchmark_passages"]
    items = [tuple(r) for r in common.table(spark, sf_dir, "benchmark").collect()]
    assert {i for i, _ in texts(after)} == {r[0] for r in brute_decontamination(texts(before), items) if not r[-1]}
    assert len(texts(after)) < len(texts(before))
    tokens = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        tokens[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= r["bucket"] <= packing.LONGEST
    assert tokens == {i: len((t or "").encode().split()) for i, t in texts(docs)}
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()))


@pytest.mark.parametrize("tables", ["edge", "empty"])
def test_edge_and_empty_tables(spark, tables, request):
    d = request.getfixturevalue(tables)
    got = corpus_pipeline.run(spark, d)
    assert "bucket" in got.columns and (tables == "edge" or got.count() == 0)
