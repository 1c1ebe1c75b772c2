"""Weights are read by rows, and anew after they have moved."""

import numpy as np

from loomgraph.llm import maxent


def test_scores_are_sums_of_weights():
    m, rng = maxent.Model.__new__(maxent.Model), np.random.default_rng(1)
    m.rows, m.turned = 64, None
    m.class_prior = rng.random(maxent.CLASSES).astype(np.float32)
    rows = rng.integers(0, m.rows, (maxent._FEATURES, maxent.BLOCK + 5))
    for _ in range(2):
        m.weights = rng.standard_normal((2, maxent.CLASSES, m.rows)).astype(np.float32)
        want = sum(m.weights[0][:, r] for r in rows) + m.class_prior[:, None]
        assert np.allclose(m.scores(0, rows, rows[0]), want - want.max(0), atol=1e-5)
        assert m.turned[1].shape == (2, m.rows, maxent.CLASSES)
