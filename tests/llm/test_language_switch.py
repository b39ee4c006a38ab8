"""Viterbi may only be skipped where it would give one language."""

import numpy as np
import pytest

from veriframe.llm import language


def value(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


def test_two_languages_that_cover_a_text():
    scores = np.array([(-1.7, 0.0, -3.5)] * 6 + [(-1.7, -3.5, 0.0)] * 6)
    assert language.label_words(scores, 12.0).tolist() == [1] * 6 + [2] * 6


def test_labels_are_as_good_as_viterbi():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        scores = -rng.exponential(2.0, (rng.integers(1, 25), rng.integers(1, 5)))
        got, want = language.label_words(scores, 12.0), language.viterbi(scores, 12.0)
        assert value(scores, got, 12.0) == pytest.approx(value(scores, want, 12.0))
