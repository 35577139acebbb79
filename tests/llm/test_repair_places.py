"""Places of pairs, grouped: by one number where pair and place fit into it, by an index otherwise."""

import numpy as np

from marlstone.llm import repair


def test_both_ways_to_group_places_agree():
    seq = np.random.default_rng(4).integers(0, 9, 5000)
    at = np.flatnonzero(seq[:-1] != 3)
    one, two = repair._by_pair(seq, at, 9), repair._by_pair(seq, at, 1 << 30)
    assert all(np.array_equal(x, y) for x, y in zip(one, two))
    pairs, count, place = one
    assert np.array_equal(np.repeat(pairs, count), (seq[place] << 32) | seq[place + 1])
    assert sorted(place.tolist()) == at.tolist()
    none = repair._by_pair(seq, at[:0], 9)
    assert [len(x) for x in none] == [0, 0, 0]
