"""Thresholds aim at the corpus's precision, whatever the sample's share of toxic rows."""

import numpy as np

from tracewright.llm import toxicity


def test_weights_move_the_threshold():
    scores, labels = np.array([0.9] * 19 + [0.6, 0.5]), np.array([1] * 19 + [0, 1])
    assert toxicity.threshold(scores, labels) == toxicity.LOWEST
    assert toxicity.threshold(scores, labels, weights=np.where(labels == 1, 1.0, 10.0)) == 0.75
