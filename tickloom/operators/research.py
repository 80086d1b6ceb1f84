"""Experiment surfaces: event order, the feature registry, expanding fits, trailing
brackets, risk choice, and null batches for the deflated decision."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import stats
from tickloom.operators import features
from tickloom.operators.slices import expanding_sums

# Event kinds in order of execution, lower first. Reset and swap may
# change places by venue, nothing else moves.
EVENT_KINDS = ("market_status", "rule_reset", "swap_posting", "quote", "pending_trigger", "fill", "stop_or_target", "decision", "submission")
# Trailing brackets in risks.
TRAIL_AXES = {"act_r": (0.75, 1.0, 1.5), "sl_r": (0.75, 1.0, 1.5), "tp_r": (1.5, 3.0, 6.0)}


def event_priority(kind: Column, reset_before_swap: bool = True) -> Column:
    """Sort key of an event kind; an unknown kind is an error."""
    order = list(EVENT_KINDS)
    if not reset_before_swap:
        order[1], order[2] = order[2], order[1]
    at = F.array_position(F.array(*[F.lit(k) for k in order]), kind)
    return F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), kind)).cast("long"))


def trails() -> list[dict]:
    return [dict(zip(TRAIL_AXES, v)) for v in itertools.product(*TRAIL_AXES.values())]


def best_fitting(results: DataFrame, by: str, dd_budget: float) -> DataFrame:
    """Of the risks inside the drawdown budget, the one with the best median return,
    ties to the smaller risk."""
    inside = results.where(F.col("max_dd_pct") < dd_budget)
    best = F.max_by(F.struct("risk", "max_dd_pct", "median"), F.struct("median", -F.col("risk")))
    return inside.groupBy(by).agg(best.alias("_b")).select(by, "_b.*")


def expanding_fit(rows: DataFrame, at: str, value: str, fitted_to, by: str = "symbol") -> DataFrame:
    """rows with the mean and count of the values up to each, none after fitted_to:
    an artefact that is fitted anew as time goes on, until its calibration ends."""
    x = F.when(F.col(at) <= F.lit(fitted_to).cast("timestamp_ntz"), F.col(value))
    t = expanding_sums(rows, at, x, "_sum", "observations", [by])
    return t.withColumn("fitted", F.try_divide("_sum", "observations")).select(*rows.columns, "fitted", "observations")


@dataclass
class Feature:
    name: str
    build: Callable[[DataFrame], DataFrame]
    warmup: int
    version: int = 1
    return_series: bool = False


@dataclass
class Registry:
    """Features with the truncation case each must pass."""

    items: dict[str, Feature] = field(default_factory=dict)

    def add(self, f: Feature) -> None:
        if f.name in self.items:
            raise ValueError(f"{f.name} is registered already")
        self.items[f.name] = f

    def gaps(self, columns: list[str]) -> list[str]:
        """Feature columns nobody registered."""
        return sorted(set(columns) - set(self.items))

    def leaks(self, inputs: DataFrame, cutoffs: list) -> list[str]:
        """Features that change when later input is removed."""
        return [f.name for f in self.items.values() if any(features.truncation_difference(f.build, inputs, at, [f.name], f.warmup) for at in cutoffs)]


def library() -> Registry:
    r = Registry()
    r.add(Feature("ret_1", features.returns_and_atr, 1, return_series=True))
    r.add(Feature("atr", features.returns_and_atr, 14))
    for n in ("spread_median", "spread_ratio", "spread_regime"):
        r.add(Feature(n, features.spread_regime, 60))
    for n in ("trend_strength", "trend_state"):
        r.add(Feature(n, features.trend_regime, 200))
    r.add(Feature("vol_regime_quintile", lambda b: features.vol_quintile(features.returns_and_atr(b)), 280))
    return r


def null_batches(spark: SparkSession, batches: int, candidates: int = 40, periods: int = 1000, seed: int = 40, loading: float = 0.7, edge: float = 0.0, ar: float = 0.15) -> DataFrame:
    """Per batch: the best ratio among candidates that share a factor, their
    dispersion, and the index of the candidate with an edge (that ratio in total
    variance, with serially correlated noise; none where edge is 0).

    A batch is drawn from its own seed, so any layout gives the same rows.
    """

    def run(parts):
        for part in parts:
            out = []
            for b in part["id"]:
                r = np.random.default_rng([seed, int(b)])
                x = loading * r.standard_normal(periods) + r.standard_normal((candidates, periods))
                lucky = int(r.integers(candidates)) if edge else -1
                if edge:
                    shocks = r.standard_normal(periods)
                    shocks[0] = 0.0
                    noise = pd.Series(shocks).ewm(alpha=1 - ar, adjust=False).mean().to_numpy() / (1 - ar)
                    total = loading**2 + 1 + 1 / (1 - ar**2)
                    x[lucky] += edge * np.sqrt(total) + noise
                sr = x.mean(1) / x.std(1, ddof=1)
                out.append((int(b), float(sr.max()), int(sr.argmax()), float(sr.std(ddof=1)), lucky))
            yield pd.DataFrame(out, columns=["batch", "best", "best_at", "s", "edge_at"])

    return spark.range(batches).mapInPandas(run, "batch long, best double, best_at long, s double, edge_at long")


def deflated(batches: DataFrame, candidates: int, periods: int) -> DataFrame:
    """batches with the hurdle, z and whether the best passes at 95 %."""
    t = batches.withColumn("hurdle", F.col("s") * stats.expected_maximum(candidates))
    se = F.sqrt((1 + 0.5 * F.col("best") * F.col("best")) / (periods - 1))
    t = t.withColumn("z", (F.col("best") - F.col("hurdle")) / se)
    return t.withColumn("passes", F.col("z") >= 1.6448536269514722)
