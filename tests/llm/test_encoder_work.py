"""What the byte-level encoder leaves to the library: few calls for many words, and stops and line starts as words of their own."""

from itertools import product

import pyarrow as pa

from marlstone.llm.encoding import WordCachedEncoder
from marlstone.llm.queries import vocabulary


def encoded(enc, texts):
    ids, ends = enc.encode(pa.array(texts))
    want = [enc.tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w]
    assert ends.tolist() == [sum(map(len, want[: k + 1])) for k in range(len(want))]


def test_many_new_words_take_few_calls():
    enc = WordCachedEncoder(vocabulary("byte_bpe_50k.json"), True, 0)
    calls, merged = [], enc.merged
    enc.merged = lambda spelt: calls.append(spelt) or merged(spelt)
    encoded(enc, [" ".join("".join(x) for x in product("thenqzé", repeat=4) if "é" not in x)])
    assert len(calls) <= 50  # 1296 words


def test_a_merge_over_two_words_sends_them_alone():
    enc = WordCachedEncoder(vocabulary("byte_bpe_50k.json"), True, 0)
    enc.leads[:] = False
    encoded(enc, ["some words that stand alone"])


def test_stops_and_line_starts_are_words_of_their_own():
    enc = WordCachedEncoder(vocabulary("byte_bpe_50k.json"), True, 0)
    encoded(enc, ["Lathing. Thered, a.\nThered été, Été. over.\n", "\nThered. ", "a.. b ., c, . d.,\n's it's. 3. x\u0301. ñ. \u00aa. ", "", ".", "\n", "a. ", ", b", "a.\n.b"])
    assert "over" in enc.words and not {"Lathing.", "Thered,", "over."} & set(enc.words)
