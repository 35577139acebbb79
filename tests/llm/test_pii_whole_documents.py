"""Operator 4: a disclosing term is generalised wherever it stands in a document with the value."""

from pyspark.sql import functions as F

from marlstone.llm import pii


def clean(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.text_spans(docs).join(docs, "doc_id").orderBy("doc_id")
    return [r[0] for r in got.select(pii.sanitised(F.col("text"), F.col("spans"))).collect()]


def others(n):
    return [(100 + i, f"common words number{i} end here") for i in range(n)]


def test_far_terms_and_all_their_occurrences(spark):
    far = "common words " * 10 + "\n\n"
    out = clean(spark, [(i, f"number{i} Zorblax {far}jo@acme.org here zorblax end {far}ZORBLAX") for i in range(3)] + others(12))
    assert all("zorblax" not in x.lower() and x.count("[TERM]") == 3 for x in out[:3])
    assert out[3] == "common words number0 end here"


def test_runs_of_digits_do_not_end_the_context(spark):
    out = clean(spark, [(i, f"zorblax in 1999 paid 4111 1111 1111 1111 here number{i}") for i in range(3)] + others(12))
    assert all("zorblax" not in x and "[CARD]" in x for x in out[:3])
