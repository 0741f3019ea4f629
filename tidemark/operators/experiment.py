"""Chronological experiment: fit on train, choose on selection, calibrate, and score the final block once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, ridge
from .features import fraction_bounds, purge


def tail_guard(n: int, model: float | None, base: float | None, least: int = 20, most_worse: float = 0.05) -> tuple[bool, str]:
    """Too few tail rows come first, then a degradation of more than `most_worse`."""
    if n < least:
        return False, "INSUFFICIENT_TAIL_ROWS"
    if model is None or base is None or model > base * (1 + most_worse):
        return False, "TAIL_DEGRADATION"
    return True, "TAIL_GUARD_PASSED"


@dataclass(frozen=True)
class Candidate:
    """A family of features at its best penalty, judged on the selection block."""

    family: str
    model: ridge.Ridge
    mae: float
    guard: bool
    reason: str


def choose(simple: Sequence[Candidate], richer: Sequence[Candidate], reference_mae: float, rows: int, least_rows: int = 100, least_gain: float = 5.0, margin: float = 0.5) -> tuple[Candidate, bool]:
    """The candidate, and whether it is promoted over the reference.

    The best simple family that passes its guard (the best of all where none does) stays, unless a richer one with a
    passed guard is better by `margin` per cent. Promotion asks for rows, a gain of `least_gain` per cent and the guard.
    """
    best = min([c for c in simple if c.guard] or simple, key=lambda c: c.mae)
    for c in richer:
        if c.guard and best.mae and 100 * (best.mae - c.mae) / best.mae >= margin:
            best = c
    gain = 100 * (reference_mae - best.mae) / reference_mae if reference_mae else float("nan")
    return best, rows >= least_rows and gain >= least_gain and best.guard


def _judge(family: str, features: Sequence[str], train: DataFrame, selection: DataFrame, target: str, reference: str, last: str, cut: float) -> Candidate:
    model, maes = ridge.select_alpha(ridge.moments(train, features, target), selection, target)
    mae = maes.filter(F.col("alpha") == model.alpha).first().mae
    tail = selection.dropna(subset=[*features, target, reference]).filter(F.abs(F.col(target) - F.col(last)) >= F.lit(cut))
    t = tail.agg(F.count("*").alias("n"), F.avg(F.abs(model.predict() - F.col(target))).alias("m"), F.avg(F.abs(F.col(reference) - F.col(target))).alias("b")).first()
    return Candidate(family, model, float("inf") if mae is None else mae, *tail_guard(t.n, t.m, t.b))


def run(blocks: dict[str, DataFrame], simple: dict[str, Sequence[str]], richer: dict[str, Sequence[str]], target: str, reference: str, last: str, coverage: float = 0.9, scale_floor: float | None = None, scale_alpha: float = 10.0, least_calibration: int = 1) -> DataFrame:
    """blocks: train, selection, calibration, final, with slot and decision_slot. One row: the choice, q and final figures.

    Each block is purged against the next. The family and penalty are chosen on the selection block, its tail being the
    moves from `last` above the train block's 90 per cent quantile. If the family is promoted, it is fitted again on train
    and selection; else the reference is deployed. Intervals are split conformal on the calibration block: of one width,
    or with `scale_floor` times a local scale, which learns from residuals of the selection block only. Only a handful
    of numbers come back to the driver between the steps, which selection before scoring makes necessary.
    """
    names = list(blocks)
    blocks = {n: purge(b, blocks[after]) if after else b for (n, b), after in zip(blocks.items(), [*names[1:], None], strict=True)}
    train, selection = blocks["train"], blocks["selection"]
    cut = train.agg(F.percentile(F.abs(F.col(target) - F.col(last)), 0.9)).first()[0]
    judge = lambda families: [_judge(n, f, train, selection, target, reference, last, cut or 0.0) for n, f in families.items()]
    known = selection.dropna(subset=[target, reference]).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(target) - F.col(reference))).alias("mae")).first()
    best, promoted = choose(judge(simple), judge(richer), known.mae or 0.0, known.n)
    features = best.model.features
    if promoted:
        model = ridge.solve(ridge.moments(train.unionByName(selection), features, target), best.model.alpha)
        point, early = model.predict(), best.model.predict()
    else:
        point = early = F.col(reference)
    scale = F.lit(1.0)
    if scale_floor is not None:
        residuals = selection.dropna(subset=[*features, target, reference]).withColumn("_residual", F.col(target) - early)
        scale = ridge.local_scale(ridge.fit_local_scale(residuals, features, "_residual", scale_alpha), scale_floor)
    complete = lambda name: blocks[name].dropna(subset=[*features, target, reference, last]).withColumns({"prediction": point, "_scale": scale})
    errors = complete("calibration").withColumn("score", F.abs(F.col("prediction") - F.col(target)) / F.col("_scale")).withColumn("g", F.lit(1))
    q = metrics.conformal_quantile(errors, "score", coverage, ["g"]).filter(F.col("n") >= least_calibration).select("q")
    final = complete("final").join(F.broadcast(q), how="left")  # one row, or none with too few rows to calibrate on
    final = final.withColumns({"lower": F.col("prediction") - F.col("q") * F.col("_scale"), "upper": F.col("prediction") + F.col("q") * F.col("_scale")})
    figures = {**{f"model_{k}": c for k, c in metrics.point(target, "prediction", last).items()}, **{f"reference_{k}": c for k, c in metrics.point(target, reference, last).items()}, **{f"interval_{k}": c for k, c in metrics.interval(target, "lower", "upper", coverage).items()}, **{f"abstention_{k}": c for k, c in metrics.abstention(target, "prediction", "lower", "upper", last).items()}}
    head = {"family": best.family, "alpha": best.model.alpha, "guard": best.reason, "promoted": promoted, "deployed": best.family if promoted else "REFERENCE_FALLBACK", "selection_mae": best.mae}
    return final.agg(*(F.lit(v).alias(k) for k, v in head.items()), F.first("q").alias("q"), *(c.alias(k) for k, c in figures.items()))


def fraction_split(df: DataFrame, *shares: float, least: int = 30, slot: str = "slot") -> list[DataFrame]:
    """Chronological blocks that end at floor(n * cumulative share); the rest is the last one. Slots are unique.

    The slots at the bounds come from the rows' order; only they are gathered, so blocks are range filters on the input.
    """
    n = df.count()
    if n < least:
        raise ValueError(f"{n} rows are too few to split, {least} are needed")
    bounds = fraction_bounds(n, *shares)
    if not all(a < b for a, b in zip([0, *bounds], [*bounds, n])):
        raise ValueError("a block of the split would be empty")
    at = [r[slot] for r in df.select(slot).withColumn("_k", F.row_number().over(Window.orderBy(slot)) - 1).filter(F.col("_k").isin(bounds)).orderBy("_k").collect()]
    low, high = [None, *at], [*at, None]
    inside = lambda a, b: (F.lit(True) if a is None else F.col(slot) >= a) & (F.lit(True) if b is None else F.col(slot) < b)
    return [df.filter(inside(a, b)) for a, b in zip(low, high)]


def dated_blocks(df: DataFrame, bounds: Sequence[int], names: Sequence[str] = ("train", "selection", "calibration", "final"), slot: str = "slot") -> dict[str, DataFrame]:
    """Half-open blocks between strictly increasing bounds, one more than there are names."""
    if len(bounds) != len(names) + 1 or not all(a < b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("bounds must increase strictly, one more than blocks")
    return {n: df.filter((F.col(slot) >= a) & (F.col(slot) < b)) for n, a, b in zip(names, bounds, bounds[1:])}
