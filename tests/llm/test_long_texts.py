"""Long texts are worked through in parts; the parts change nothing."""

import random

import numpy as np

from amendry.llm import windows
from amendry.llm.lempel_ziv import WORDS
from amendry.llm.simhash import _ones
from amendry.llm.suffix_groups import BYTES
from amendry.llm.textarrays import words_of


def test_hashes_of_words_by_parts():
    text = " ".join(random.Random(1).choice(["a", "bb", "ccc" * 9, "é"]) for _ in range(5000)).encode()
    words = words_of([text, b"", text])
    assert np.array_equal(words.hashes(), words.hashes(most=700))


def test_bits_by_parts():
    rng = np.random.default_rng(2)
    number = np.array([1, 7, 300, 2, 90])
    hashes = rng.integers(0, 1 << 64, number.sum(), dtype=np.uint64)
    assert np.array_equal(_ones(hashes, number), _ones(hashes, number, most=23))


def test_each_window_lies_in_one_part():
    rng = random.Random(3)
    text = "".join(rng.choice("ab \n\t é") for _ in range(4000)).encode()
    for kind, size in ((WORDS.kind, 13), (BYTES.kind, 50)):
        units = (lambda t: t.split()) if kind == "words" else (lambda t: [t[i : i + 1] for i in range(len(t))])
        whole = units(text)
        found = [unit + i for unit, part in windows._parts_of(text, kind, size - 1, 170) for i in range(len(units(part)) - size + 1)]
        assert found == list(range(len(whole) - size + 1))
        for unit, part in windows._parts_of(text, kind, size - 1, 170):
            assert units(part) == whole[unit : unit + len(units(part))]
