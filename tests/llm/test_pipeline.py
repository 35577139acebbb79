"""The corpus pipeline, stage by stage, against brute force."""

import re

import pytest
from test_operators import odd_documents, plain_groups, plain_ids

import corpus_pipeline
from marlstone.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"file://{folder}/{i}")
        after = spark.read.parquet(f"file://{folder}/{i}")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, *_ in stages] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_clean_documents(stages, spark, sf):
    _, before, after = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in after.collect()}
    good = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 0]
    assert sum(d in left for d in good) >= 0.97 * len(good) and sum(d in left for d in bad) <= 0.2 * len(bad)


def test_exact_stage_keeps_the_largest_id(stages):
    _, before, after = stages[1]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())


def test_near_stage_keeps_one_of_each_group(stages):
    _, before, after = stages[2]
    rows = before.collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(plain_groups(rows)))


def test_packing_stage_holds_all_tokens(stages):
    _, before, after = stages[4]
    want = sum(len(plain_ids(queries.vocabulary("word_bpe_49k.json"), r.text)) + 1 for r in before.collect())
    assert sum(r.length for r in after.collect()) == want


def test_mixing_stage_repeats_whole_documents(stages):
    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = after.collect()
    assert all(texts[r.doc_id] == r.text for r in rows)
    total = sum(words(t) for t in texts.values())
    assert abs(sum(words(r.text) for r in rows) - total) <= 0.05 * total


def test_stages_take_awkward_rows(spark, sf):
    for docs in (odd_documents(spark), odd_documents(spark).where("false")):
        for _, f in corpus_pipeline.STAGES:
            f(spark, docs, sf).count()
