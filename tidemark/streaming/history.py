"""Residual corrections from scored history as a stream: keyed state, bounded by timers, instead of a join of whole histories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import SLOT_US

SETTLE, SHORT, LONG, LEAST_SHORT, LEAST_LONG = 4, 12, 96, 8, 24
SLOT_MS, _WORD = SLOT_US // 1000, (1 << 64) - 1
#: Decisions that wait for the watermark, scores within reach, and the targets ever scored: one bit each, 64 to a word (2 KB a year).
STATE = (
    "now array<long>, ridge array<double>, slot array<long>, known array<long>, usable array<long>, forecast array<double>, "
    "residual array<double>, seen_word array<long>, seen_bits array<long>, repeat_at long"
)
OUTPUT = "now long, ridge double, short_rows long, long_rows long, short_mean double, long_mean double, proposal double, anchor_delta double, reason string, ridge_consensus double, ridge_direction_veto double"


def messages(decisions: DataFrame, scores: DataFrame, by: str) -> DataFrame:
    """decisions(by, now, ridge) and scores(by, slot, scored_at, verified, forecast, actual), times in slots, as one stream.

    The event time of a score is when it can first be used: its outcome has settled and it has been scored. Scores that
    were not verified before their target are left out.
    """
    at = lambda c: F.timestamp_micros(c * F.lit(SLOT_US)).alias("at")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    usable = F.greatest(F.col("slot") + SETTLE, F.col("scored_at"))
    d = decisions.select(by, at(F.col("now")), F.lit("decision").alias("kind"), F.col("now").alias("slot"), F.col("now").alias("usable"), F.col("ridge").alias("forecast"), none("double", "residual"))
    s = scores.filter("verified").select(by, at(usable), F.lit("score").alias("kind"), "slot", usable.alias("usable"), "forecast", (F.col("actual") - F.col("forecast")).alias("residual"))
    return d.unionByName(s)


def ticks(spark, keys: list[str], by: str, slot: int) -> DataFrame:
    """Messages that move event time on without saying anything, so that what waits is answered."""
    return spark.createDataFrame([(k, slot) for k in keys], f"{by} string, slot long").select(by, F.timestamp_micros(F.col("slot") * F.lit(SLOT_US)).alias("at"), F.lit("tick").alias("kind"), "slot", F.col("slot").alias("usable"), F.lit(None).cast("double").alias("forecast"), F.lit(None).cast("double").alias("residual"))


class History:
    """State of one stream of scores; times are slots."""

    def __init__(self, held: tuple | None) -> None:
        lists = [list(x) for x in held[:-1]] if held else [[] for _ in range(9)]
        self.decisions = list(zip(lists[0], lists[1], strict=True))
        self.scores = list(zip(*lists[2:7], strict=True))
        self.seen = {int(w): int(b) & _WORD for w, b in zip(lists[7], lists[8], strict=True)}
        self.repeat_at = held[-1] if held else None

    def held(self) -> tuple:
        columns = lambda rows, n: [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(n)]
        return (*columns(self.decisions, 2), *columns(self.scores, 5), *columns([(w, b - (b >> 63 << 64)) for w, b in self.seen.items()], 2), self.repeat_at)

    def add(self, rows: pd.DataFrame) -> None:
        for r in rows.itertuples(index=False):
            if r.kind == "decision":
                self.decisions.append((int(r.slot), float(r.forecast)))
            elif r.kind == "score":
                self.scores.append((int(r.slot), int(r.slot) + SETTLE, int(r.usable), float(r.forecast), float(r.residual)))
                self._see(int(r.slot), int(r.usable))

    def _see(self, slot: int, usable: int) -> None:
        """A target that comes again blocks from the later of its two first uses on."""
        word, bit = divmod(slot, 64)
        if self.seen.get(word, 0) >> bit & 1:
            uses = sorted(s[2] for s in self.scores if s[0] == slot)
            at = uses[1] if len(uses) > 1 else usable
            self.repeat_at = at if self.repeat_at is None else min(self.repeat_at, at)
        self.seen[word] = self.seen.get(word, 0) | 1 << bit

    def answer(self, watermark: int) -> list[tuple]:
        """Decisions that no score can reach any more, and what no later decision needs goes."""
        due = sorted(d for d in self.decisions if d[0] <= watermark)
        self.decisions = [d for d in self.decisions if d[0] > watermark]
        out = [self._judge(*d) for d in due]
        earliest = min([watermark, *(d[0] for d in self.decisions)])
        self.scores = [s for s in self.scores if max(s[1], s[2]) > watermark or s[1] > earliest - LONG]
        return out

    def _judge(self, now: int, ridge: float) -> tuple:
        long = sorted(s for s in self.scores if s[2] <= now and now - LONG < s[1] <= now)
        short = [s for s in long if s[1] > now - SHORT]
        repeated, enough = self.repeat_at is not None and self.repeat_at <= now, len(short) >= LEAST_SHORT and len(long) >= LEAST_LONG
        means = [float(np.mean([s[4] for s in x])) if enough else None for x in (short, long)]
        proposal = 0.0
        if not repeated and enough and means[0] and np.sign(means[0]) == np.sign(means[1]):
            proposal = float(np.sign(means[0]) * min(abs(m) for m in means))
        delta = ridge - long[-1][3] if proposal else None
        aligned = proposal != 0 and np.sign(delta) == np.sign(proposal)
        if repeated:
            reason = "DUPLICATE_SCORED_TARGET"
        elif not enough:
            reason = "WAIT_FOR_GENUINE_PRETARGET_SCORES"
        elif not proposal:
            reason = "DISAGREEMENT_FALLBACK_RIDGE"
        else:
            reason = "SAME_SIGN_RESIDUALS" if aligned else "FROZEN_RIDGE_DIRECTION_VETO"
        return now, ridge, len(short), len(long), *means, proposal, delta, reason, ridge + proposal, ridge + (proposal if aligned else 0.0)

    def next_timer(self, watermark: int) -> int | None:
        """The first decision that waits; else when the newest score leaves the long look-back and its room is free."""
        if self.decisions:
            return min(d[0] for d in self.decisions)
        return max((s[1] + LONG for s in self.scores), default=None)


def corrections(stream: DataFrame, by: str, late: str = "1 hour") -> DataFrame:
    """messages() of any number of keys to one row per decision, as the batch form gives it.

    A decision waits until the watermark has passed it, when no score that it may use can come any more; a timer wakes
    its key even if nothing else comes. State holds the scores of the last 48 hours, decisions that wait, and one bit for each
    target ever scored. What comes later than `late` is dropped, as the watermark says.
    """
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = History(state.get if state.exists else None)
        if not state.hasTimedOut:
            for rows in batches:
                history.add(rows)
        watermark = state.getCurrentWatermarkMs() // SLOT_MS
        answers = history.answer(watermark)
        state.update(history.held())
        if (timer := history.next_timer(watermark)) is not None:
            state.setTimeoutTimestamp(max(timer * SLOT_MS, state.getCurrentWatermarkMs() + 1))
        if answers:
            out = pd.DataFrame(answers, columns=names).astype({"short_mean": float, "long_mean": float, "anchor_delta": float})
            out.insert(0, by, key[0])
            yield out

    return stream.withWatermark("at", late).groupBy(by).applyInPandasWithState(update, f"{by} string, {OUTPUT}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
