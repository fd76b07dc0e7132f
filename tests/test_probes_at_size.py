"""what a block of queries sends to each task is a bit a list and query, not a vector."""

import pickle

import numpy as np

from sieveline.operators import ann


def test_a_blocks_probes_are_small_and_right():
    rng = np.random.default_rng(1)
    centroids, vectors = ann.unit(rng.standard_normal((300, 16)).astype(np.float32)), ann.unit(rng.standard_normal((500, 16)).astype(np.float32))
    asks = ann.probed(vectors, centroids, 225)
    assert len(pickle.dumps(asks)) < 300 * 64 + 1000  # 7 MB of vectors before
    bits = np.unpackbits(asks, axis=1, count=500).astype(bool)
    assert (bits.sum(axis=0) == 225).all()
    scores = centroids @ vectors.T
    assert (np.where(bits, scores, np.inf).min(axis=0) >= np.where(bits, -np.inf, scores).max(axis=0)).all()
