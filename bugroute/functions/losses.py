"""Loss functions as Column expressions (LS1-LS14).

``labels`` and ``pre_output`` are array<double> columns of equal length
(n_out).  The activation is applied to ``pre_output`` first.  Formulas are
the public definitions of the 14 named losses; logarithms take their input
clipped to [EPS, 1 - EPS].  Everything is JVM-side higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugroute.functions.arrays import with_scalar

EPS = 1e-10

# The 14 loss names of the loss-function contract, in its order.
LOSS_NAMES = [
    "BinaryXENT", "CosineProximity", "Hinge", "KLD", "MAE", "L1", "MAPE",
    "MCXENT", "MSE", "L2", "MSLE", "NegativeLogLikelihood", "Poisson", "SquaredHinge",
]
ALIASES = {"XENT": "BinaryXENT", "NLL": "NegativeLogLikelihood",
           "KL_DIVERGENCE": "KLD", "MEAN_ABSOLUTE_ERROR": "MAE",
           "MEAN_ABSOLUTE_PERCENTAGE_ERROR": "MAPE", "MEAN_SQUARED_LOGARITHMIC_ERROR": "MSLE",
           "SQUARED_LOSS": "L2", "COSINE_PROXIMITY": "CosineProximity",
           "NEGATIVELOGLIKELIHOOD": "NegativeLogLikelihood", "SQUARED_HINGE": "SquaredHinge"}
ACTIVATIONS = ["identity", "sigmoid", "softmax", "tanh", "relu", "softsign"]


def canonical(name: str) -> str:
    if name in LOSS_NAMES:
        return name
    up = name.upper()
    if up in ALIASES:
        return ALIASES[up]
    for n in LOSS_NAMES:
        if n.upper() == up:
            return n
    raise ValueError(f"unknown loss {name!r}")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def activate(pre_output: Column | str, activation: str) -> Column:
    z = _col(pre_output).cast("array<double>")
    a = activation.lower()
    if a == "identity":
        return z
    if a == "sigmoid":
        return F.transform(z, lambda x: 1.0 / (1.0 + F.exp(-x)))
    if a == "tanh":
        return F.transform(z, lambda x: F.tanh(x))
    if a == "relu":
        return F.transform(z, lambda x: F.greatest(x, F.lit(0.0)))
    if a == "softsign":
        return F.transform(z, lambda x: x / (1.0 + F.abs(x)))
    if a == "softmax":
        e = with_scalar(z, F.array_max(z), lambda a, m: F.transform(a, lambda x: F.exp(x - m)))
        # each step binds its scalar and its array once (no work repeated an element)
        bound = F.transform(F.array(F.struct(e.alias("e"))), lambda t: F.struct(
            t["e"].alias("e"), F.aggregate(t["e"], F.lit(0.0), lambda acc, x: acc + x).alias("total")))
        return F.transform(bound, lambda t: F.transform(t["e"], lambda x: x / t["total"]))[0]
    raise ValueError(f"unknown activation {activation!r}")


def _clip(x, lo=EPS, hi=1.0 - EPS):
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def _ln(x):
    """Natural log with IEEE results outside the domain (Spark's log gives null)."""
    return (F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _safe_div(num, den):
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num / den)


def example_score(name: str, labels: Column | str, output: Column | str, mask: Column | str | None = None) -> Column:
    """Per-example loss given labels and *activated* output.

    ``mask``: an array with a factor for each output's share of the score; norms
    and the number of outputs that a loss divides by stay those of all outputs.
    """
    name = canonical(name)
    y = _col(labels).cast("array<double>")
    p = _col(output).cast("array<double>")
    n_out = F.size(y).cast("double")

    def zsum(f):
        shares = F.zip_with(y, p, f)
        if mask is not None:
            shares = F.zip_with(shares, _col(mask).cast("array<double>"), lambda s, m: s * m)
        return _sum(shares)

    if name == "MSE":
        return zsum(lambda a, b: (a - b) * (a - b)) / n_out
    if name == "L2":
        return zsum(lambda a, b: (a - b) * (a - b))
    if name == "MAE":
        return zsum(lambda a, b: F.abs(a - b)) / n_out
    if name == "L1":
        return zsum(lambda a, b: F.abs(a - b))
    if name in ("MCXENT", "NegativeLogLikelihood"):
        return -zsum(lambda a, b: a * F.log(_clip(b)))
    if name == "BinaryXENT":
        return -zsum(lambda a, b: a * F.log(_clip(b)) + (1.0 - a) * F.log(1.0 - _clip(b)))
    if name == "CosineProximity":
        dot = zsum(lambda a, b: a * b)
        ny = F.sqrt(_sum(F.transform(y, lambda a: a * a)))
        np_ = F.sqrt(_sum(F.transform(p, lambda b: b * b)))
        return -_safe_div(dot, ny * np_)
    if name == "Hinge":
        return zsum(lambda a, b: F.greatest(F.lit(0.0), 1.0 - a * b))
    if name == "SquaredHinge":
        return zsum(lambda a, b: F.pow(F.greatest(F.lit(0.0), 1.0 - a * b), 2))
    if name == "KLD":
        return zsum(lambda a, b: _clip(a, EPS, 1.0) * F.log(_clip(a, EPS, 1.0) / _clip(b, EPS, 1.0)))
    if name == "MAPE":
        return 100.0 * zsum(lambda a, b: F.when(a == 0, F.lit(float("nan")))
                             .otherwise(F.abs((a - b) / a))) / n_out
    if name == "MSLE":
        return zsum(lambda a, b: F.pow(_ln((b + 1.0) / (a + 1.0)), 2)) / n_out
    if name == "Poisson":
        return zsum(lambda a, b: b - a * F.log(_clip(b))) / n_out
    raise ValueError(name)


def loss_score(name: str, labels: Column | str, pre_output: Column | str,
               activation: str = "identity", mask: Column | str | None = None) -> Column:
    """Per-example loss from labels and the pre-activation output (``mask``: by output)."""
    return example_score(name, labels, activate(pre_output, activation), mask)
