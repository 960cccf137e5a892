from __future__ import annotations

import math

import numpy as np
import pytest

from cohortry.operators import selection


def plain(x, b, epochs, hidden=64, rate=0.01, seed=42):
    """The same training on one matrix in memory."""
    p = x.shape[1]
    sizes = [p, hidden, b, hidden, p]
    rng = np.random.default_rng(seed)
    ws = [rng.normal(0, math.sqrt(2.0 / m), (m, n)) for m, n in zip(sizes, sizes[1:])] + [np.zeros(n) for n in sizes[1:]]
    first, second = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    for step in range(1, epochs + 2):
        acts = [x]
        for i in range(4):
            z = acts[-1] @ ws[i] + ws[4 + i]
            acts.append(np.maximum(z, 0) if i < 3 else z)
        if step > epochs:
            return np.square(acts[-1] - x).mean(axis=0)
        delta, grads = 2 * (acts[-1] - x) / x.size, [None] * 8
        for i in reversed(range(4)):
            grads[i], grads[4 + i] = acts[i].T @ delta, delta.sum(axis=0)
            delta = (delta @ ws[i].T) * (acts[i] > 0)
        for i, g in enumerate(grads):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            ws[i] = ws[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)


def test_epochs_stream_packed_blocks(spark, monkeypatch):
    monkeypatch.setattr(selection, "NETWORK_ROWS", 16)
    x = np.random.default_rng(1).normal(size=(130, 4))
    x[:, 3] = x[:, 0] - x[:, 1]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ["a", "b", "c", "d"])
    scaled = np.array(selection.standardise(df, ["a", "b", "c", "d"]).collect(), dtype=float)
    wanted = plain(scaled, 2, 6)
    for parts in (1, 3):
        found = selection.network_reconstruction_error(df.repartition(parts), ["a", "b", "c", "d"], width=2, epochs=6)
        assert list(found.values()) == pytest.approx(wanted.tolist(), rel=1e-6)
