import warnings

import numpy as np
import pytest

warnings.filterwarnings("ignore", category=RuntimeWarning)

from bugroute.functions.losses import LOSS_NAMES
from bugroute.operators import losses as L

EPS = 1e-10


def np_act(z, a):
    if a == "softmax":
        e = np.exp(z - z.max())
        return e / e.sum()
    if a == "sigmoid":
        return 1 / (1 + np.exp(-z))
    return z


def np_loss(name, y, p):
    c = np.clip(p, EPS, 1 - EPS)
    n = len(y)
    return {
        "MSE": ((y - p) ** 2).sum() / n, "L2": ((y - p) ** 2).sum(),
        "MAE": np.abs(y - p).sum() / n, "L1": np.abs(y - p).sum(),
        "MCXENT": -(y * np.log(c)).sum(), "NegativeLogLikelihood": -(y * np.log(c)).sum(),
        "BinaryXENT": -(y * np.log(c) + (1 - y) * np.log(1 - c)).sum(),
        "CosineProximity": -(y @ p) / (np.linalg.norm(y) * np.linalg.norm(p)),
        "Hinge": np.maximum(0, 1 - y * p).sum(), "SquaredHinge": (np.maximum(0, 1 - y * p) ** 2).sum(),
        "KLD": (np.clip(y, EPS, 1) * np.log(np.clip(y, EPS, 1) / np.clip(p, EPS, 1))).sum(),
        "MAPE": 100 * np.abs((y - p) / y).sum() / n,
        "MSLE": (np.log((p + 1) / (y + 1)) ** 2).sum() / n,
        "Poisson": (p - y * np.log(c)).sum() / n,
    }[name]


@pytest.mark.parametrize("name", LOSS_NAMES)
@pytest.mark.parametrize("act", ["identity", "sigmoid", "softmax"])
def test_loss_matches_numpy(spark, name, act):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(5):
        y = rng.random(4) + 0.1
        z = rng.normal(size=4)
        rows.append((i, y.tolist(), z.tolist(), float(i % 2)))
    df = spark.createDataFrame(rows, "id int, labels array<double>, pre_output array<double>, mask double")
    got = {r.id: r.score for r in L.loss(df, name, activation=act).collect()}
    for i, y, z, _ in rows:
        want = np_loss(name, np.array(y), np_act(np.array(z), act))
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12, nan_ok=True)
    tot = L.loss_total(df, name, activation=act, mask="mask").first()
    want_total = sum(np_loss(name, np.array(y), np_act(np.array(z), act)) * m for _, y, z, m in rows)
    assert tot.total == pytest.approx(want_total, rel=1e-9, nan_ok=True)
    assert tot.average == pytest.approx(want_total / len(rows), rel=1e-9, nan_ok=True)
