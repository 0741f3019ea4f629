"""Walk-forward evaluation: every fold fits, chooses, fits again and scores, all folds in the same few jobs.

Training blocks of rolling folds overlap almost wholly. Rows are therefore summed once, by the segments that all folds' bounds
cut time into, and a fold's sums are those of its segments. Systems of all folds, families and penalties are solved on the
executors in Arrow batches, and predictions are joined back as linear forms. The driver knows the bounds of the folds, a few
numbers for each, and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import causal, metrics
from .features import in_folds

MODEL = "fold int, kind string, family string, alpha double, n_fit long, intercept double, weights array<double>"


@dataclass(frozen=True)
class Family:
    """A set of features; a richer one has to be better by a margin than what it would replace."""

    name: str
    features: tuple[str, ...]
    richer: bool = False


@dataclass(frozen=True)
class Plan:
    families: tuple[Family, ...]
    target: str
    reference: str
    last: str
    alphas: tuple[float, ...] = (0.0, 1.0, 10.0, 100.0)
    least_tail: int = 20
    most_worse: float = 0.05
    margin: float = 0.5
    least_rows: int = 100
    least_gain: float = 5.0

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(f for family in self.families for f in family.features))

    @property
    def core(self) -> list[str]:
        return list(dict.fromkeys([self.target, self.reference, self.last]))


def purged(rows: DataFrame, folds: DataFrame, slot: str = "slot", decision: str = "decision_slot") -> DataFrame:
    """folds with train_end and selection_end: the slots from which on a row's outcome is not known at the next block's first decision."""
    blocks = in_folds(rows, folds, slot).groupBy("fold").agg(*(F.min(F.when(F.col("block") == b, F.col(decision))).alias(f"{b}_first") for b in ("selection", "calibration")))
    met = folds.join(F.broadcast(blocks), "fold", "left")  # a row for each fold
    end = lambda block, bound: F.least(F.col(bound), F.coalesce(F.col(f"{block}_first"), F.col(bound))).alias
    return met.select(*folds.columns, end("selection", "selection_start")("train_end"), end("calibration", "calibration_start")("selection_end"))


def sums_by_segment(rows: DataFrame, bounds: Sequence[int], columns: Sequence[str], shift: Sequence[float], slot: str = "slot") -> DataFrame:
    """(segment, n, s0.., p0_0..): counts, sums and products of shifted columns between consecutive bounds; a segment is named by its first slot."""
    cuts = F.array(*map(F.lit, bounds))
    at = F.size(F.filter(cuts, lambda b: b <= F.col(slot)))
    x = [F.col(c) - m for c, m in zip(columns, shift, strict=True)]
    k = range(len(columns))
    return rows.withColumn("_at", at).filter("_at > 0").groupBy(F.element_at(cuts, F.col("_at")).alias("segment")).agg(
        F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in k), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in k for j in k if i <= j))


def _solved(plan: Plan, shift: Sequence[float]):
    """All families and penalties of a fold's sums, as linear forms over plan.features (weights of features not in the family are 0)."""
    features, k = plan.features, len(plan.features) + 1

    def forms(row: dict) -> Iterator[tuple]:
        n = row["n"]
        mean = np.array([row[f"s{i}"] for i in range(k)]) / n
        second = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
        centre = mean + np.array(shift)
        for family in plan.families:
            at = [features.index(f) for f in family.features]
            scale = np.sqrt(np.maximum(second[at, at], 0))
            scale[scale == 0] = 1.0
            gram, cross = second[np.ix_(at, at)] / np.outer(scale, scale) * n, second[at, -1] / scale * n
            for alpha in plan.alphas:
                system = gram + alpha * np.eye(len(at))
                singular = alpha == 0 and np.linalg.matrix_rank(system) < len(at)
                beta = np.linalg.pinv(system, hermitian=True) @ cross if singular else np.linalg.solve(system, cross)
                weights = np.zeros(len(features))
                weights[at] = beta / scale
                yield row["fold"], row["kind"], family.name, float(alpha), n, float(centre[-1] - weights @ centre[:-1]), weights.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f for row in b.to_pylist() for f in forms(row)]
            columns = list(zip(*found, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["fold", "kind", "family", "alpha", "n_fit", "intercept", "weights"])

    return run


def fit(rows: DataFrame, folds: DataFrame, plan: Plan, slot: str = "slot") -> DataFrame:
    """MODEL rows: for every fold, family and penalty one fit on the training block (`train`) and one on it and the selection block (`point`).

    folds are those of purged(); rows are complete in all families' features, so that families are compared on the same rows.
    """
    columns = [*plan.features, plan.target]
    known = folds.select("fold", "train_start", "selection_start", "train_end", "selection_end").collect()  # a few numbers a fold
    bounds = sorted({b for f in known for b in (f.train_start, f.train_end, f.selection_start, f.selection_end)})
    shift = [x or 0.0 for x in rows.agg(*(F.avg(c) for c in columns)).first()]
    sums = sums_by_segment(rows, bounds, columns, shift, slot)
    at, kind = F.col("segment"), F.col("kind")
    inside = ((at >= F.col("train_start")) & (at < F.col("train_end"))) | ((kind == "point") & (at >= F.col("selection_start")) & (at < F.col("selection_end")))
    uses = folds.select("fold", "train_start", "train_end", "selection_start", "selection_end", F.explode(F.array(F.lit("train"), F.lit("point"))).alias("kind"))
    totals = sums.join(F.broadcast(uses), inside).groupBy("fold", "kind").agg(*(F.sum(c).alias(c) for c in sums.columns if c != "segment"))  # two rows a fold by four segments a fold
    return totals.mapInArrow(_solved(plan, shift), MODEL)


def predicted(plan: Plan, intercept: str = "intercept", weights: str = "weights") -> Column:
    """The value of a row's linear form; features that it does not weigh may be missing."""
    x = F.array(*(F.col(f).cast("double") for f in plan.features))
    terms = F.zip_with(x, F.col(weights), lambda a, w: F.when(w == 0, 0.0).otherwise(a * w))
    return F.col(intercept) + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def choose(rows: DataFrame, folds: DataFrame, models: DataFrame, plan: Plan, slot: str = "slot") -> DataFrame:
    """One row a fold: family, alpha, guard, figures on the selection block, promoted or not.

    The best penalty of a family has the least mean error (ties to the smaller). A family's guard compares it with the reference on moves from `last` above the
    training block's 90 per cent quantile. The best simple family that passes, or the best of all simple ones, stays unless a richer one that
    passes is better by `margin` per cent.
    """
    s, y, ref = F.col(slot), F.col(plan.target), F.col(plan.reference)
    few = F.broadcast(folds)  # a row for each fold
    train = rows.join(few, (s >= F.col("train_start")) & (s < F.col("train_end")))
    cut = train.groupBy("fold").agg(F.percentile(F.abs(y - F.col(plan.last)), 0.9).alias("cut"))
    block = rows.join(few, (s >= F.col("selection_start")) & (s < F.col("selection_end"))).join(F.broadcast(cut), "fold")
    forms = models.filter("kind = 'train'").groupBy("fold").agg(F.collect_list(F.struct("family", "alpha", "intercept", "weights")).alias("forms"))
    each = block.join(F.broadcast(forms), "fold").withColumn("form", F.explode("forms"))  # families x penalties forms a fold
    error, base = F.abs(y - predicted(plan, "form.intercept", "form.weights")), F.abs(y - ref)
    tail = F.abs(y - F.col(plan.last)) >= F.col("cut")
    judged = each.groupBy("fold", F.col("form.family").alias("family"), F.col("form.alpha").alias("alpha")).agg(
        F.avg(error).alias("mae"), F.count("*").alias("n"), F.avg(base).alias("base"), F.count_if(tail).alias("n_tail"), F.avg(F.when(tail, error)).alias("tail"), F.avg(F.when(tail, base)).alias("tail_base"))
    best = judged.groupBy("fold", "family").agg(F.min(F.struct("mae", "alpha", "n", "base", "n_tail", "tail", "tail_base")).alias("b")).select("fold", "family", "b.*")
    order = F.coalesce(*(F.when(F.col("family") == f.name, k) for k, f in enumerate(plan.families)))
    richer = F.coalesce(*(F.when(F.col("family") == f.name, f.richer) for f in plan.families))
    reason = F.when(F.col("n_tail") < plan.least_tail, "INSUFFICIENT_TAIL_ROWS").when(F.coalesce(F.col("tail") > F.col("tail_base") * (1 + plan.most_worse), F.lit(True)), "TAIL_DEGRADATION").otherwise("TAIL_GUARD_PASSED")
    listed = best.withColumns({"order": order, "richer": richer, "reason": reason})
    arrays = listed.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("mae", "order", "family", "alpha", "richer", "reason", "n", "base"))).alias("all"))
    passed = lambda c: c["reason"] == "TAIL_GUARD_PASSED"
    simple = F.filter("all", lambda c: ~c["richer"])
    safe = F.filter(simple, passed)
    start = F.when(F.size(safe) > 0, F.get(safe, F.lit(0))).otherwise(F.get(simple, F.lit(0)))
    rich = F.array_sort(F.filter("all", lambda c: c["richer"] & passed(c)), lambda a, b: a["order"] - b["order"])
    gains = lambda b, c: F.when((b["mae"] != 0) & (100 * (b["mae"] - c["mae"]) / b["mae"] >= plan.margin), c).otherwise(b)
    out = arrays.withColumn("start", start).select("fold", F.aggregate(rich, F.col("start"), gains).alias("c")).select("fold", "c.family", "c.alpha", "c.reason", F.col("c.mae").alias("selection_mae"), F.col("c.base").alias("reference_mae"), F.col("c.n").alias("selection_rows"))
    gain = F.when(F.col("reference_mae") != 0, 100 * (F.col("reference_mae") - F.col("selection_mae")) / F.col("reference_mae"))
    promoted = (F.col("selection_rows") >= plan.least_rows) & F.coalesce(gain >= plan.least_gain, F.lit(False)) & (F.col("reason") == "TAIL_GUARD_PASSED")
    return out.withColumns({"gain_pct": gain, "promoted": promoted})


def base_rows(rows: DataFrame, folds: DataFrame, models: DataFrame, choices: DataFrame, plan: Plan, slot: str = "slot") -> DataFrame:
    """(fold, block, slot, actual, frozen, reference): warm-up and scored rows of every fold with what it deploys.

    A row is left out for a missing feature only if the deployed family has that feature.
    """
    points = models.filter("kind = 'point'").drop("kind")
    deployed = choices.join(points, ["fold", "family", "alpha"]).select("fold", "promoted", "intercept", "weights")
    s = F.col(slot)
    final = in_folds(rows, folds, slot).filter(s >= F.col("warmup_start")).join(F.broadcast(deployed), "fold")  # a form for each fold
    value = F.when(F.col("promoted"), predicted(plan)).otherwise(F.col(plan.reference))
    out = final.withColumn("frozen", value).dropna(subset=[*plan.core, "frozen"])
    return out.select("fold", "block", slot, F.col(plan.target).alias("actual"), "frozen", F.col(plan.reference).alias("reference"))


def suite(base: DataFrame, rule: causal.Rule = causal.Rule(), slot: str = "slot") -> DataFrame:
    """The three causal candidates side by side on one base sequence for each fold: mean, consensus, consensus with direction veto."""
    mean = causal.mean_correction(base, "actual", "frozen", rule, ["fold"], slot).withColumnRenamed("corrected", "mean_48h").drop("residual", "history_rows", "correction")
    both = causal.direction_veto(causal.consensus_correction(mean, "actual", "frozen", rule, ["fold"], slot), "frozen")
    return both.withColumnsRenamed({"corrected": "consensus", "veto_prediction": "direction_veto"})


def fold_summary(scored: DataFrame, by: Sequence[str] = ("fold",), methods: Sequence[str] = ("reference", "frozen", "mean_48h", "consensus", "direction_veto")) -> DataFrame:
    """Figures by fold and method, with the gain over the frozen base and over the reference and how often it wins."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("value")) for m in methods)))
    size = lambda c: F.abs(F.col(c) - F.col("actual"))
    long = scored.select(*by, "actual", "frozen", "reference", each.alias("e")).select(*by, "actual", "frozen", "reference", "e.method", "e.value")
    figures = metrics.point("actual", "value")
    gain = lambda base: (100 * (F.avg(size(base)) - F.avg(size("value"))) / F.when(F.avg(size(base)) != 0, F.avg(size(base))))
    wins = {f"win_rate_vs_{b}": F.avg((size("value") < size(b)).cast("double")) for b in ("frozen", "reference")}
    return long.groupBy(*by, "method").agg(*(c.alias(k) for k, c in figures.items()), *(gain(b).alias(f"improvement_vs_{b}_pct") for b in ("frozen", "reference")), *(c.alias(k) for k, c in wins.items()))


def run(rows: DataFrame, folds: DataFrame, plan: Plan, slot: str = "slot", decision: str = "decision_slot") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choices of every fold, its models, and its warm-up and scored rows under the suite."""
    common = rows.dropna(subset=[*plan.core, *plan.features, decision])
    cut = purged(common, folds, slot, decision)
    models = fit(common, cut, plan, slot)
    choices = choose(common, cut, models, plan, slot)
    return choices, models, suite(base_rows(rows, folds, models, choices, plan, slot), slot=slot)
