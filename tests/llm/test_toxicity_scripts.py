"""Toxicity on texts whose words are not parted by ASCII characters."""

import random

import numpy as np
import pytest

from tracewright.llm import toxicity


def test_every_byte_is_in_a_word():
    assert toxicity.words_of("a\u00a0b\u2014\u201cC\u201d") == [b"a", b"b", b"c"]
    assert toxicity.words_of("x" * 50 + " y") == [b"x" * 24, b"x" * 24, b"xx", b"y"]
    assert toxicity.words_of("ab\u4f60\u597d\u3002\u597dc") == ["ab".encode(), "\u4f60\u597d".encode(), "\u597d".encode(), "\u597d".encode(), b"c"]


@pytest.mark.parametrize("sep", ["", "\u00a0", "\u2014"])
def test_a_late_passage_counts(sep):
    rng = random.Random(3)
    chars = [chr(0x4E00 + k) for k in range(300)] if not sep else [f"w{k}" for k in range(300)]
    bad = "\u8d25\u7c7b\u8d25" if not sep else "idiot"
    rows = []
    for k in range(400):
        said = [rng.choice(chars) for _ in range(40)]
        if k % 2:
            said[30:30] = [bad] * 2
        rows.append(sep.join(said))
    y = np.arange(400) % 2 * 1.0
    net = toxicity.train(rows[:300], y[:300], 0.5)
    assert ((net.score(rows[300:]) > 0.5) == (y[300:] == 1)).mean() > 0.95
