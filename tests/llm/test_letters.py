"""Words of Latin letters take a shorter way to their ids; the library is the measure."""

import random
import string

import pyarrow as pa
import pytest

from marlstone.llm.encoding import WordCachedEncoder
from marlstone.llm.queries import vocabulary

LETTERS = string.ascii_letters + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
OTHERS = "İıŉǅªµ×÷́̇ͅÅﬁẞ0123½中'’"
PIECES = [*LETTERS, *OTHERS, *string.punctuation, "'s", "'ll", "the", "ing", "ción", "STRASSE"]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("capacity", [5, 100_000])
def test_words_of_letters_encode_like_the_library(name, spaces, capacity):
    draw = random.Random(7)
    word = lambda k: "".join(draw.choices(k, k=draw.randint(1, 9)))
    tailed = lambda: word(LETTERS) + "".join(draw.choices(string.punctuation, k=draw.randint(0, 4)))
    gaps = [" ", " ", " ", "\n"]
    texts = ["".join(x for _ in range(30) for x in (draw.choice([tailed, lambda: word(PIECES)])(), draw.choice(gaps))) for _ in range(400)]
    texts += ["", "Été", "ß", "it's its' dogs'.", *LETTERS]
    enc = WordCachedEncoder(vocabulary(name), spaces, 3, capacity=capacity)
    for part in (texts[:100], texts[100:], texts[:50]):
        ids, ends = enc.encode(pa.array(part))
        want = [enc.tok.encode(t, add_special_tokens=False).ids + [3] for t in part]
        assert ids.tolist() == [i for w in want for i in w]
        assert ends.tolist() == [sum(map(len, want[: k + 1])) for k in range(len(want))]
