"""Operator 6: free cuts where a text has no sentence ends."""

import inspect

from marlstone.llm import packing, queries


def test_grid_of_cuts_is_fine_enough():
    assert inspect.signature(packing.pack).parameters["grid"].default <= 64


def test_padding_of_texts_without_sentence_ends(spark):
    words = queries.vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, "the " * (2050 + 97 * i)) for i in range(12)], "doc_id long, text string")

    def cost(**how):
        by = packing.pack(docs, words, **how).groupBy("sequence_id").sum("length").collect()
        return sum(0 if n & (n - 1) == 0 else 2048 - n for _, n in by)

    assert cost() == cost(grid=64)
