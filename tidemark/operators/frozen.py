"""Frozen model state: a text artefact with its digest, refused if it is not what was locked, and replay against locked predictions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .ridge import Ridge

SCHEMA, STATUS = "tidemark-frozen-ridge-v1", "FROZEN_MODEL_STATE_EXPORTED"


class StateRefused(ValueError):
    """A state that is not the locked one; `reason` is one word."""

    def __init__(self, reason: str, detail: str = "") -> None:
        super().__init__(f"{reason} {detail}".strip())
        self.reason = reason


@dataclass(frozen=True)
class Frozen:
    """A model with its family, horizon in minutes and conformal quantile."""

    family: str
    horizon: int
    model: Ridge
    q: float

    def to_text(self) -> str:
        """Canonical JSON: sorted keys, no spaces, no NaN."""
        m = self.model
        body = {"schema": SCHEMA, "status": STATUS, "family": self.family, "horizon_minutes": self.horizon, "q": self.q, "features": m.features, "alpha": m.alpha, "mean": m.mean, "scale": m.scale, "coef": m.coef}
        return json.dumps(body, sort_keys=True, separators=(",", ":"), allow_nan=False)

    def digest(self) -> str:
        return hashlib.sha256(self.to_text().encode()).hexdigest()


def load(text: str, locked: str, families: Mapping[str, Sequence[str]], horizon: int) -> Frozen:
    """The state of a text whose digest is the locked one.

    Checked in this order: the bytes, the schema tag and status, the family and horizon, the order of features as the family has it, and the numbers.
    """
    if hashlib.sha256(text.encode()).hexdigest() != locked:
        raise StateRefused("BYTES_NOT_LOCKED")
    d = json.loads(text)
    if d.get("schema") != SCHEMA or d.get("status") != STATUS:
        raise StateRefused("UNSUPPORTED_SCHEMA")
    if d["family"] not in families or d["horizon_minutes"] != horizon:
        raise StateRefused("UNEXPECTED_FAMILY_OR_HORIZON")
    if list(d["features"]) != list(families[d["family"]]):
        raise StateRefused("FEATURE_ORDER")
    try:
        model = Ridge(tuple(d["features"]), float(d["alpha"]), tuple(d["mean"]), tuple(d["scale"]), tuple(d["coef"]))
    except ValueError as e:
        raise StateRefused("BAD_NUMBERS", str(e)) from e
    return Frozen(d["family"], d["horizon_minutes"], model, float(d["q"]))


def write_state(spark: SparkSession, state: Frozen, path: str) -> str:
    """The artefact as one text file that is written once; its digest."""
    spark.createDataFrame([(state.to_text(),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return state.digest()


def read_state(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value.removesuffix("\n")


def same_quantile(state: Frozen, calibration: DataFrame, target: str, coverage: float = 0.9, tolerance: float = 1e-8) -> None:
    """The conformal quantile of the calibration rows, recomputed, must be the locked one."""
    scores = calibration.dropna(subset=[*state.model.features, target]).withColumn("score", F.abs(state.model.predict() - F.col(target))).withColumn("g", F.lit(1))
    found = metrics.conformal_quantile(scores, "score", coverage, ["g"]).first()
    if found is None or abs(found.q - state.q) > tolerance:
        raise StateRefused("QUANTILE_NOT_REPRODUCED", f"locked {state.q}, recomputed {found and found.q}")


def replay(state: Frozen, rows: DataFrame, locked: DataFrame, key: str = "slot", prediction: str = "prediction", tolerance: float = 1e-8) -> DataFrame:
    """One row: locked and replayed counts, the largest difference, and `status`: PASS, ROW_COUNT_MISMATCH or PREDICTION_MISMATCH."""
    again = rows.dropna(subset=list(state.model.features)).select(key, state.model.predict().alias("_again"))
    met = locked.select(key, F.col(prediction).alias("_locked")).join(again, key, "left")
    out = met.agg(F.count("*").alias("locked_rows"), F.count("_again").alias("replayed_rows"), F.max(F.abs(F.col("_locked") - F.col("_again"))).alias("largest_difference"))
    status = F.when(F.col("locked_rows") != F.col("replayed_rows"), "ROW_COUNT_MISMATCH").when(F.coalesce(F.col("largest_difference") > tolerance, F.lit(True)), "PREDICTION_MISMATCH").otherwise("PASS")
    return out.withColumn("status", status)
