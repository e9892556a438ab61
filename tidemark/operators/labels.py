"""Forward-looking targets. Reads bars only: nothing here knows state or features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import KEY, block_window, framed, own, point_of

TYPES = ("future_return", "direction", "excursion", "tp_before_sl")


class TargetError(ValueError):
    """A target that no data could satisfy."""


@dataclass(frozen=True)
class Target:
    name: str
    kind: str
    horizon: int
    threshold_points: float | None = None
    side: str | None = None
    take_profit_points: float | None = None
    stop_loss_points: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in TYPES:
            raise TargetError(f"{self.kind!r} is not one of {TYPES}")
        if self.horizon < 1:
            raise TargetError("the horizon is at least one bar")
        if (self.kind == "direction") != (self.threshold_points is not None) or (self.threshold_points or 0) < 0:
            raise TargetError("a direction, and nothing else, has a threshold of at least 0")
        barriers = (self.side, self.take_profit_points, self.stop_loss_points)
        if self.kind == "tp_before_sl":
            if self.side not in ("long", "short") or not (self.take_profit_points or 0) > 0 or not (self.stop_loss_points or 0) > 0:
                raise TargetError("a barrier race has a side, a take profit and a stop loss above 0")
        elif any(b is not None for b in barriers):
            raise TargetError(f"a {self.kind} has no barriers")


def _bad(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def _points(c: Column) -> Column:
    return F.round(c / point_of(), 6)


def target_values(bars: DataFrame, target: Target) -> DataFrame:
    """One row per bar close: whether the target is resolved, why not, and its values."""
    w, h = block_window(), target.horizon
    ahead = w.rowsBetween(1, h)
    ref = F.col("close")
    null = lambda kind: F.lit(None).cast(kind)
    rows = framed(bars, 0, h).withColumns(
        {
            "as_of": F.col("close_time"), "spec_name": F.lit(target.name), "target_type": F.lit(target.kind), "horizon_bars": F.lit(h), "reference_price": ref,
            "future_window_start": F.lead("close_time", 1).over(w), "future_window_end": F.lead("close_time", h).over(w), "_n": F.count(F.lit(1)).over(ahead), "_final": F.lead("close", h).over(w), "_ref_bad": _bad(ref),
        }
    )
    short, bad = F.col("_n") < h, F.lit("malformed_future_bar")
    out = {c: null(t) for c, t in (("future_return", "double"), ("future_move_points", "double"), ("direction", "string"), ("up_excursion_points", "double"), ("down_excursion_points", "double"), ("outcome", "string"), ("resolving_bar_timestamp", "timestamp"))}
    if target.kind == "tp_before_sl":
        tp, sl = target.take_profit_points * point_of(), target.stop_loss_points * point_of()
        long = target.side == "long"
        upper, lower = ref + (tp if long else sl), ref - (sl if long else tp)
        rows = rows.withColumn("_up", upper).withColumn("_down", lower)
        seen = F.struct("close_time", "high", "low")
        rows = rows.withColumn("_w", F.collect_list(seen).over(ahead))
        hit = lambda b: _bad(b["high"]) | _bad(b["low"]) | (b["high"] >= F.col("_up")) | (b["low"] <= F.col("_down"))
        rows = rows.withColumn("_hit", F.get(F.filter("_w", hit), F.lit(0)))
        up, down, broken = F.col("_hit.high") >= F.col("_up"), F.col("_hit.low") <= F.col("_down"), _bad(F.col("_hit.high")) | _bad(F.col("_hit.low"))
        none = F.col("_hit").isNull()
        reason = F.when(F.col("_ref_bad"), bad).when(none, F.when(short, "insufficient_history").otherwise("no_touch_within_horizon")).when(broken, bad).when(up & down, "same_bar_ambiguity")
        win = up if long else down
        malformed = F.col("_ref_bad") | (~none & broken)
        out["outcome"] = F.when(~malformed, F.when(none | (up & down), "unresolved").when(win, "tp_first").otherwise("sl_first"))
        out["resolving_bar_timestamp"] = F.when(~F.col("_ref_bad") & ~none & ~broken, F.col("_hit.close_time"))
    elif target.kind == "excursion":
        rows = rows.withColumn("_hi", F.max("high").over(ahead)).withColumn("_lo", F.min("low").over(ahead)).withColumn("_bad", F.count_if(_bad(F.col("high")) | _bad(F.col("low"))).over(ahead) > 0)
        reason = F.when(F.col("_ref_bad"), bad).when(short, "insufficient_history").when(F.col("_bad"), bad)
        out["up_excursion_points"] = F.when(reason.isNull(), _points(F.col("_hi") - ref))
        out["down_excursion_points"] = F.when(reason.isNull(), _points(ref - F.col("_lo")))
    else:
        reason = F.when(F.col("_ref_bad"), bad).when(short, "insufficient_history").when(_bad(F.col("_final")), bad)
        move = _points(F.col("_final") - ref)
        out["future_return"] = F.when(reason.isNull(), F.try_divide(F.col("_final") - ref, ref))
        out["future_move_points"] = F.when(reason.isNull(), move)
        if target.kind == "direction":
            t = float(target.threshold_points)
            out["direction"] = F.when(reason.isNull(), F.when(move >= t, "up").when(move <= -t, "down").otherwise("neutral"))
    rows = own(rows).withColumn("unresolved_reason", reason).withColumns(out).withColumn("resolved", F.col("unresolved_reason").isNull())
    return rows.select(*KEY, "as_of", "spec_name", "target_type", "horizon_bars", "reference_price", "future_window_start", "future_window_end", "resolved", "unresolved_reason", *out)


def all_targets(bars: DataFrame, targets: list[Target]) -> DataFrame:
    """The targets' rows below each other."""
    out = target_values(bars, targets[0])
    for t in targets[1:]:
        out = out.unionByName(target_values(bars, t))
    return out


def value_at(bars: DataFrame, target: Target, as_of) -> DataFrame:
    """The target's rows of the series that have a bar closing at that very instant; raises if
    none has. Reads that bar and the horizon's."""
    t = F.lit(as_of).cast("timestamp")
    at = bars.filter(F.col("close_time") == t).select(*KEY, F.col("idx").alias("_at"))
    if at.isEmpty():
        raise TargetError(f"{as_of} is no bar close: an observation is anchored to one")
    near = bars.join(at, list(KEY)).filter(F.col("idx").between(F.col("_at"), F.col("_at") + target.horizon)).drop("_at")
    return target_values(near, target).filter(F.col("as_of") == t)
