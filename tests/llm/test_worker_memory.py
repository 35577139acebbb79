"""Python workers live on with the tasks of other operators: what they keep, and what scoring holds at once."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from marlstone.llm import common, encoding, packing, quality
from marlstone.llm.queries import vocabulary


def test_an_operator_drops_what_others_keep():
    path = vocabulary("word_bpe_49k.json")
    common.byte_hasher()
    list(encoding.encoded_batches([pa.record_batch({"text": ["some words"]})], "text", path, False, 1))
    assert common.byte_hasher.cache_info().currsize == 0
    assert encoding.encoder.cache_info().currsize == 1
    common.byte_hasher()
    common.begin(common.byte_hasher)
    assert common.byte_hasher.cache_info().currsize == 1
    assert encoding.encoder.cache_info().currsize == 0


def test_scoring_holds_little_and_scores_alike():
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdeé中", k=5)) for _ in range(draw.randint(0, 500))) for _ in range(2000)]
    texts[700] = None
    logit = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    whole = np.concatenate([quality.score_texts([t or ""], logit, 0.1) for t in texts])
    quality.score_series(pd.Series(texts[:1]), logit, 0.1)  # the hasher's table stays
    tracemalloc.start()
    got = quality.score_series(pd.Series(texts), logit, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == whole.tolist()
    assert peak < 40 << 20
    assert len(quality.score_series(pd.Series([], dtype=object), logit, 0.1)) == 0


def test_sentence_enders_are_read_once():
    path = vocabulary("word_bpe_49k.json")
    assert packing.sentence_enders(path) is packing.sentence_enders(path)
