"""Long paragraphs: the same ratio as SequenceMatcher's, without its time."""

import random
import time
from difflib import SequenceMatcher

import pytest

from stylometra.operators import marking as M


@pytest.mark.parametrize("least", [0, 40_000])
def test_matching_is_that_of_the_standard_library(monkeypatch, least):
    monkeypatch.setattr(M, "LONG_RANGE", least)
    rng = random.Random(7)
    for k in range(120):
        letters = "ab" if k % 3 == 0 else "abcdё \U0001f600"
        a = "".join(rng.choices(letters, k=rng.randrange(0, 400)))
        b = [*a]
        for _ in range(rng.randrange(0, 12)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", "x", "ab", "aa"])
        b = "".join(b)
        matcher = SequenceMatcher(None, a, b, autojunk=False)
        assert M.matching(a, b) == sum(x.size for x in matcher.get_matching_blocks())
        assert M.may_match(a, b) or matcher.ratio() < M.SAME


def test_long_paragraphs_are_quick():
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(300)]
    a = " ".join(rng.choices(words, k=12_000))
    b = a.replace(" " + words[0] + " ", " et ").replace(" " + words[1] + " ", " und ")
    start = time.monotonic()
    assert 0.98 <= M.likeness(a, [b], [len(b)], {b}) < 1
    assert time.monotonic() - start < 30
