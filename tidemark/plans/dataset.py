"""Datasets: features, targets and split labels of the same instants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import labels, splits
from tidemark.operators.labels import Target
from tidemark.plans.market import Market
from tidemark.plans.state import FEATURES, feature_vectors
from tidemark.schema import INSTRUMENTS, KEY, Timeframe
from tidemark.sources.shared import kept

# Threshold, take profit and stop loss in points, and horizons, of each
# production series.
PRODUCTION = {
    ("EURUSD", "1h"): (36, 85, 85, (1, 2, 4, 8)), ("EURUSD", "4h"): (74, 179, 179, (1, 2, 4)), ("EURUSD", "1d"): (182, 462, 462, (1, 2)),
    ("XAUUSD", "1h"): (5360, 13840, 13840, (1, 2, 4, 8)), ("XAUUSD", "4h"): (10550, 27885, 27885, (1, 2, 4)), ("XAUUSD", "1d"): (28675, 78960, 78960, (1, 2)),
}


def parameters_for(symbol: str, tf: Timeframe) -> tuple:
    """The production parameters of a series; raises outside the production universe."""
    key = (symbol.strip().upper(), tf.name)
    if key not in PRODUCTION:
        raise ValueError(f"{key} is not in production; symbols {sorted(INSTRUMENTS)}, timeframes 1h, 4h, 1d")
    return PRODUCTION[key]


def production_targets(symbol: str, tf: Timeframe) -> list[Target]:
    threshold, tp, sl, horizons = parameters_for(symbol, tf)
    out = []
    for h in horizons:
        out += [Target(f"ret_{h}", "future_return", h), Target(f"dir_{h}", "direction", h, threshold_points=threshold), Target(f"exc_{h}", "excursion", h)]
        out += [Target(f"tpsl_{h}_{side}", "tp_before_sl", h, side=side, take_profit_points=tp, stop_loss_points=sl) for side in ("long", "short")]
    return out


@dataclass(frozen=True)
class DatasetSpec:
    targets: tuple[Target, ...]
    train: float = 0.6
    validation: float = 0.2
    embargo_bars: int | None = None

    @property
    def longest(self) -> int:
        return max((t.horizon for t in self.targets), default=0)

    @property
    def embargo(self) -> int:
        """At least the longest horizon; a shorter one that was asked for is refused."""
        if self.embargo_bars is None:
            return self.longest
        if self.embargo_bars < self.longest:
            raise splits.SplitError(f"an embargo of {self.embargo_bars} bars is shorter than the longest horizon, {self.longest}")
        return self.embargo_bars


def build(m: Market, spec: DatasetSpec) -> DataFrame:
    """One row per bar close: features, `targets` (an array of structs) and the split."""
    values = labels.all_targets(m.bars, list(spec.targets))
    cols = [c for c in values.columns if c not in (*KEY, "as_of")]
    by_row = values.groupBy(*KEY, "as_of").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("targets"), F.max("future_window_end").alias("window_end"))
    rows = kept(feature_vectors(m).join(by_row, [*KEY, "as_of"]), "dataset")
    return splits.assign(rows, splits.by_proportion(rows, spec.train, spec.validation), spec.embargo)


def flat(rows: DataFrame, target: str) -> DataFrame:
    """Identity, features and one target's columns; null where a number is missing."""
    t = F.filter("targets", lambda x: x["spec_name"] == target)
    names = ("target_type", "horizon_bars", "resolved", "unresolved_reason", "future_return", "future_move_points", "direction", "up_excursion_points", "down_excursion_points", "outcome", "resolving_bar_timestamp")
    wide = rows.withColumn("_t", F.get(t, F.lit(0)))
    return wide.select(*KEY, "as_of", "feature_version", "label", "natural_label", F.col("_t.spec_name").alias("target_name"), *FEATURES, *[F.col(f"_t.{n}").alias(f"target_{n}") for n in names])
