"""ALS by broadcast factors against dense matrices."""

import numpy as np
import pytest

from quern.operators import training


def dense(r: np.ndarray, x: np.ndarray, iterations: int, regs: float = 0.1, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(iterations):
        for side in (1, 0):
            rated = r.T if side else r
            y = x if side else z
            a = y.T @ y + alpha * np.einsum("no,od,oe->nde", rated, y, y) + regs * rated.sum(1)[:, None, None] * np.eye(y.shape[1])
            new = np.linalg.solve(a, (1 + alpha) * (rated @ y)[..., None])[..., 0].astype(np.float32).astype(float)
            x, z = (x, new) if side else (new, z)
    return x, z


@pytest.mark.parametrize("factors", [1 << 21, 16])
def test_als_is_that_of_dense_matrices(spark, monkeypatch, factors):
    """Ids with gaps, a hub item in pieces, a user of many items and repeated rows; factors in one broadcast or several."""
    monkeypatch.setattr(training, "FACTORS", factors)
    monkeypatch.setattr(training, "ADDED", 16)
    rng = np.random.default_rng(3)
    pairs = [(u, i) for u in range(60) for i in range(50) if rng.random() < 0.1 or i == 7 or u == 5] + [(3, 7), (3, 7)]
    r = np.zeros((60, 50))
    np.add.at(r, tuple(np.array(pairs).T), 1)
    inter = spark.createDataFrame([(u * 3_000_000_000 + 1, i * 10 + 4) for u, i in pairs], "u bigint, i bigint")
    model = training.als(inter, 4, iterations=3)
    start = training.first_embedding(0, 60, 4, 1, training.NODES)
    start = (start / np.sqrt((start**2).sum(1, keepdims=True))).astype(np.float32).astype(float)
    x, y = dense(r, start, 3)
    got = [{row.id: row.features for row in t.collect()} for t in (model.userFactors, model.itemFactors)]
    assert sorted(got[0]) == [u * 3_000_000_000 + 1 for u in range(60)] and sorted(got[1]) == [i * 10 + 4 for i in range(50)]
    assert np.array([got[0][k] for k in sorted(got[0])]) == pytest.approx(x, abs=1e-4)
    assert np.array([got[1][k] for k in sorted(got[1])]) == pytest.approx(y, abs=1e-4)
