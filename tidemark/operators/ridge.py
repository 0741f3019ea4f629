"""Ridge regression from one aggregation of products; the driver solves a system of the size of the feature list."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite


@dataclass(frozen=True)
class Ridge:
    """prediction = coef[0] + sum coef[j + 1] * (x[j] - mean[j]) / scale[j]"""

    features: tuple[str, ...]
    alpha: float
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...] = field(default=())

    def __post_init__(self) -> None:
        k = len(self.features)
        if not (len(self.mean) == len(self.scale) == k and len(self.coef) == k + 1):
            raise ValueError("model state has the wrong dimensions")
        if not np.isfinite([*self.mean, *self.scale, *self.coef]).all() or min(self.scale, default=1) <= 0:
            raise ValueError("model state is not finite, or a scale is not positive")

    def predict(self) -> Column:
        return sum(((F.col(f) - m) / s * b for f, m, s, b in zip(self.features, self.mean, self.scale, self.coef[1:], strict=True)), F.lit(self.coef[0]))

    def predict_strict(self) -> Column:
        """The prediction; a NULL, NaN or infinite feature or result stops the job."""
        p = self.predict()
        good = finite(p)
        for f in self.features:
            good = good & finite(F.col(f))
        return F.when(good, p).otherwise(F.raise_error(F.lit("a feature or the prediction is not finite")).cast("double"))

    def to_text(self) -> str:
        """Number of features, means, scales and coefficients: four lines of 17 significant digits."""
        if not self.features:
            raise ValueError("a model without features has no text form")
        return "\n".join([str(len(self.features)), *(" ".join(f"{v:.17g}" for v in row) for row in (self.mean, self.scale, self.coef))]) + "\n"

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "alpha": self.alpha, "mean": self.mean, "scale": self.scale, "coef": self.coef}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Ridge:
        d = json.loads(text)
        return Ridge(tuple(d["features"]), float(d["alpha"]), tuple(d["mean"]), tuple(d["scale"]), tuple(d["coef"]))


@dataclass(frozen=True)
class Moments:
    """Count, means, population deviations, and products of the standardised features with each other and the target."""

    features: tuple[str, ...]
    n: int
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    target_mean: float


def moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    """Two passes over complete rows: means and deviations, then centred products, k(k+3)/2 sums in one aggregation."""
    rows = df.dropna(subset=[*features, target])
    one = rows.agg(F.count("*").alias("n"), F.avg(target).alias("y"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    k = len(features)
    if not one.n:
        raise ValueError("no complete rows to fit on")
    mean = np.array([one[f"m{i}"] for i in range(k)])
    scale = np.array([one[f"s{i}"] or 1.0 for i in range(k)])
    z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mean, scale, strict=True)]
    y = F.col(target) - float(one.y)
    two = rows.agg(*(F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(z[i] * y).alias(f"c{i}") for i in range(k))).first()
    gram = np.array([[two[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float).reshape(k, k)
    return Moments(tuple(features), one.n, mean, scale, gram, np.array([two[f"c{i}"] for i in range(k)], float), one.y)


def solve(m: Moments, alpha: float) -> Ridge:
    """The intercept is not penalised; a negative penalty is refused. With alpha 0 and a singular system the solution of least norm is taken; else it fails."""
    if not alpha >= 0:
        raise ValueError("the penalty must be 0 or more")
    a = m.gram + alpha * np.eye(len(m.features))
    if alpha == 0 and np.linalg.matrix_rank(a) < len(a):
        b = np.linalg.pinv(a, hermitian=True) @ m.cross
    else:
        b = np.linalg.solve(a, m.cross)
    return Ridge(m.features, float(alpha), tuple(m.mean.tolist()), tuple(m.scale.tolist()), (float(m.target_mean), *b.tolist()))


def select_alpha(m: Moments, block: DataFrame, target: str, alphas: Sequence[float] = (0.0, 1.0, 10.0, 100.0)) -> tuple[Ridge, DataFrame]:
    """Least mean absolute error on the next block, ties to the smaller alpha; all alphas are scored in one job."""
    models = [solve(m, a) for a in alphas]
    rows = block.dropna(subset=[*m.features, target])
    maes = rows.agg(*(F.avg(F.abs(r.predict() - F.col(target))).alias(f"a{i}") for i, r in enumerate(models)))
    long = maes.select(F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.col(f"a{i}").alias("mae")) for i, a in enumerate(alphas)))).alias("r")).select("r.*")
    best = min(((r.mae, r.alpha) for r in long.collect() if r.mae is not None), default=(None, alphas[0]))[1]
    return models[list(alphas).index(best)], long


def fit_local_scale(df: DataFrame, features: Sequence[str], residual: str, alpha: float) -> Ridge:
    """A model of log(1 + |residual|), for intervals that widen where errors are large."""
    return solve(moments(df.withColumn("_log", F.log1p(F.abs(residual))), features, "_log"), alpha)


def local_scale(model: Ridge, floor: float) -> Column:
    """The scale that the model expects, at least `floor`, and kept from overflowing."""
    log = F.least(F.greatest(model.predict(), F.lit(float(np.log1p(floor)))), F.lit(20.0))
    return F.greatest(F.expm1(log), F.lit(floor))
