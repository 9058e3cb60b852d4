"""Sigmoid calibration of many classes at once.

Each (fold, class) needs two numbers, a and b of p = 1 / (1 + exp(a m + b)), fitted to all held-out margins
with Platt's smoothed targets. A Newton step needs six sums per (fold, class), so one pass of a partially
aggregated groupBy serves every sigmoid, and only folds x classes rows come back to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Newton's method needs a dozen passes; a sigmoid that is not done after so many is an error.
MAX_PASSES = 500
MIN_STEP = 1e-10
RIDGE = 1e-12


@dataclass
class _Fit:
    """State of one sigmoid between passes."""

    high: float
    low: float
    rows: int
    a: float
    b: float
    loss: float = math.inf
    slope: float = 0.0
    direction: tuple[float, float] = (0.0, 0.0)
    step: float = 1.0
    done: bool = False

    def trial(self) -> tuple[float, float]:
        return self.a + self.step * self.direction[0], self.b + self.step * self.direction[1]

    def take(self, s) -> None:
        """Accepts or halves the step that was just measured, then aims the next one."""
        if s["loss"] > self.loss + 1e-4 * self.step * self.slope:
            self.step /= 2
            self.done = self.step < MIN_STEP
            return
        self.a, self.b = self.trial()
        self.loss = s["loss"]
        ga, gb = s["ga"], s["gb"]
        if max(abs(ga), abs(gb)) < 1e-7 * self.rows:
            self.done = True
            return
        haa, hbb, hab = s["haa"] + RIDGE, s["hbb"] + RIDGE, s["hab"]
        det = haa * hbb - hab * hab
        self.direction = (-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det)
        self.slope = ga * self.direction[0] + gb * self.direction[1]
        self.step = 1.0


def _sums(long: DataFrame, fits: dict[int, _Fit]) -> DataFrame:
    """Loss, gradient and Hessian sums per sigmoid `k` at the trial values, which travel as constants."""
    last = max(fits)

    def of(value) -> Column:
        return F.get(F.array(*[F.lit(float(value(fits[k])) if k in fits else 0.0) for k in range(last + 1)]), F.col("k"))

    mine = long.where(F.col("k").isin(*fits))
    t = F.when(F.col("y"), of(lambda f: f.high)).otherwise(of(lambda f: f.low))
    z = of(lambda f: f.trial()[0]) * F.col("m") + of(lambda f: f.trial()[1])
    rows = mine.select("k", "m", t.alias("t"), z.alias("z"))
    p = F.when(F.col("z") >= 0, F.exp(-F.col("z")) / (1 + F.exp(-F.col("z")))).otherwise(1 / (1 + F.exp(F.col("z"))))
    loss: Column = F.when(F.col("z") >= 0, F.col("t") * F.col("z") + F.log1p(F.exp(-F.col("z")))).otherwise(
        (F.col("t") - 1) * F.col("z") + F.log1p(F.exp(F.col("z")))
    )
    rows = rows.select("k", "m", loss.alias("loss"), (F.col("t") - p).alias("d1"), (p * (1 - p)).alias("d2"))
    m = F.col("m")
    return rows.groupBy("k").agg(
        F.sum("loss").alias("loss"), F.sum(m * F.col("d1")).alias("ga"), F.sum("d1").alias("gb"),
        F.sum(m * m * F.col("d2")).alias("haa"), F.sum("d2").alias("hbb"), F.sum(m * F.col("d2")).alias("hab"),
    )


def fit_sigmoids(margins: DataFrame, n_classes: int) -> dict[tuple[int, int], tuple[float, float]]:
    """(fold, label, margins ARRAY<DOUBLE>) -> {(fold, class index): (a, b)}."""
    long = margins.select("fold", "label", F.posexplode("margins").alias("c", "m"))
    k = (F.col("fold") * n_classes + F.col("c")).alias("k")
    long = long.select(k, "m", (F.col("label") == F.col("c")).alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits: dict[int, _Fit] = {}
        for r in long.groupBy("k").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).collect():
            pos, neg = r["pos"], r["neg"]
            fits[r["k"]] = _Fit((pos + 1) / (pos + 2), 1 / (neg + 2), pos + neg, 0.0, math.log((neg + 1) / (pos + 1)))
        for _ in range(MAX_PASSES):
            unfinished = {k: f for k, f in fits.items() if not f.done}
            if not unfinished:
                break
            for s in _sums(long, unfinished).collect():
                fits[s["k"]].take(s)
        else:
            if left := [k for k, f in fits.items() if not f.done]:
                raise RuntimeError(f"sigmoids without an optimum after {MAX_PASSES} passes: {left}")
        return {divmod(k, n_classes): (f.a, f.b) for k, f in fits.items()}
    finally:
        long.unpersist()
