"""Hunks of long texts are those that SequenceMatcher finds, without its square of a text's length."""

import random
import time
from difflib import SequenceMatcher

import pytest

from inkloom.operators import diff


@pytest.mark.parametrize("short", [0, 16, 2048])
def test_gaps_are_those_of_difflib(monkeypatch, short):
    monkeypatch.setattr(diff, "_SHORT", short)
    rng, given_up = random.Random(7), 0
    for words in (["a", "b", " "], ["a", " ", "b", "  ", "c", "."], [" ", "\n", "x"], [f"w{i}" for i in range(30)] + [" "] * 20):
        for _ in range(150):
            a = [rng.choice(words) for _ in range(rng.randrange(120))]
            b = [t for t in a if rng.random() > 0.03] if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randrange(120))]
            for _ in range(rng.randrange(9)):
                b.insert(rng.randrange(len(b) + 1), rng.choice(words))
            want = [o for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
            got = diff._gaps(a, b)
            if got is None:  # more hunks than are shown, white space not counted
                given_up += 1
                assert sum(any(not t.isspace() for t in (*a[i:k], *b[j:m])) for _, i, k, j, m in want) > diff.MOST_HUNKS
            else:
                assert got == want
    assert given_up


def test_long_texts_take_no_square():
    rng = random.Random(7)
    text = " ".join(rng.choice(["the", "a", "dog", "runs", "far"]) for _ in range(20_000))
    start = time.time()
    assert diff.text_hunks(text, text.replace(" the ", " that ")) is None
    assert diff.text_hunks(text, f"{text[:40_000]}zz {text[40_000:]}") == [{"kind": "insert", "start": 40_000, "end": 40_000, "old": "", "new": "zz "}]
    assert time.time() - start < 30
