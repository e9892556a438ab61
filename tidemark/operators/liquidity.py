"""Liquidity levels of every kind, their sweeps and their life."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.search import bars_at, first_hit_two_sided, first_index_at
from tidemark.operators.swings import stamp
from tidemark.schema import BULL, KEY, point_of

BUY, SELL = "buy_side", "sell_side"
COLUMNS = (*KEY, "level_id", "liquidity_type", "side", "price_level", "created_timestamp", "confirmation_timestamp")


@dataclass(frozen=True)
class LiquidityConfig:
    equal_tolerance_points: float = 1.0
    equal_max_swing_distance: int = 5
    sweep_tolerance_points: float = 0.0
    approach_tolerance_points: float | None = None


def _level(kind: str | Column, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, *KEY, *parts)


def swing_levels(pivots: DataFrame) -> DataFrame:
    high = F.col("direction") == BULL
    rows = pivots.withColumn("liquidity_type", F.when(high, "swing_high").otherwise("swing_low")).withColumn("side", F.when(high, BUY).otherwise(SELL))
    return rows.withColumn("level_id", _level("swing", "direction", stamp("event_timestamp"))).withColumn("created_timestamp", F.col("event_timestamp")).select(*COLUMNS)


def equal_levels(pivots: DataFrame, config: LiquidityConfig = LiquidityConfig()) -> DataFrame:
    """Each swing with the few of its kind before it, at nearly the same price."""
    w = Window.partitionBy(*KEY, "direction").orderBy("event_timestamp")
    one = F.struct("event_timestamp", "confirmation_timestamp", "price_level")
    before = [f"_e{d}" for d in range(1, config.equal_max_swing_distance + 1)]
    rows = pivots.withColumns({c: F.lag(one, d).over(w) for d, c in enumerate(before, 1)})
    rows = rows.withColumn("_e", F.explode(F.array_compact(F.array(*before))))
    rows = rows.filter(F.abs(F.col("price_level") - F.col("_e.price_level")) <= config.equal_tolerance_points * point_of())
    high = F.col("direction") == BULL
    kind = F.when(high, "equal_highs").otherwise("equal_lows")
    rows = rows.withColumn("level_id", _level("equal", kind, stamp("_e.event_timestamp"), stamp("event_timestamp")))
    return rows.select(
        *KEY, "level_id", kind.alias("liquidity_type"), F.when(high, BUY).otherwise(SELL).alias("side"), F.when(high, F.greatest("price_level", "_e.price_level")).otherwise(F.least("price_level", "_e.price_level")).alias("price_level"),
        F.col("event_timestamp").alias("created_timestamp"), F.greatest("confirmation_timestamp", "_e.confirmation_timestamp").alias("confirmation_timestamp"),
    )


def _both_sides(rows: DataFrame, scope: str, prefix: str, label: Column, confirmed: str) -> DataFrame:
    one = lambda side, kind, price, at: F.struct(F.lit(side).alias("side"), F.lit(f"{prefix}_{kind}").alias("liquidity_type"), F.col(price).alias("price_level"), F.col(at).alias("created_timestamp"))
    rows = rows.withColumn("_l", F.explode(F.array(one(BUY, "high", "high_price", "high_timestamp"), one(SELL, "low", "low_price", "low_timestamp")))).withColumn("_label", label).withColumn("_c", F.col(confirmed))
    rows = rows.select(*KEY, "_l.*", "_label", F.col("_c").alias("confirmation_timestamp"))
    return rows.withColumn("level_id", _level(scope, "liquidity_type", "_label")).select(*COLUMNS)


def session_levels(done: DataFrame) -> DataFrame:
    return _both_sides(done, "session", "session", F.concat_ws(":", "name", F.col("local_date").cast("string")), "end_utc")


def period_levels(days: DataFrame, weeks: DataFrame) -> DataFrame:
    """Previous day's and week's extremes, known when the day or week has ended."""
    d = _both_sides(days.filter("completed"), "day", "previous_day", F.col("local_date").cast("string"), "end_utc")
    return d.unionByName(_both_sides(weeks.filter("completed"), "week", "previous_week", F.col("week").cast("string"), "end_utc"))


def pending_periods(days: DataFrame, weeks: DataFrame) -> DataFrame:
    """Running extremes of days and weeks that have not ended; never levels."""
    cols = ("high_price", "low_price", "start_utc", "end_utc", "observed_end")
    d = days.filter("NOT completed").select(*KEY, F.lit("day").alias("period"), F.col("local_date").alias("label"), *cols)
    return d.unionByName(weeks.filter("NOT completed").select(*KEY, F.lit("week").alias("period"), F.col("week").alias("label"), *cols))


def all_levels(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sweeps(levels: DataFrame, bars: DataFrame, config: LiquidityConfig = LiquidityConfig()) -> DataFrame:
    """The first bar that closes at or after a level's confirmation and trades beyond it;
    the bar that confirms a level may sweep it."""
    lv = first_index_at(levels, bars, "confirmation_timestamp", "close_time", "_s").filter("_s IS NOT NULL")
    buy = F.col("side") == BUY
    tol = config.sweep_tolerance_points * point_of()
    lv = lv.withColumn("_above", buy).withColumn("_level", F.when(buy, F.col("price_level") + tol).otherwise(F.col("price_level") - tol))
    hit = first_hit_two_sided(lv, bars, F.col("high"), F.col("low"), "_s", "_level", "_above").filter("hit_idx IS NOT NULL")
    hit = bars_at(hit.drop("confirmation_timestamp"), bars, "hit_idx", {"timestamp": "event_timestamp", "close_time": "confirmation_timestamp", "high": "_h", "low": "_l", "close": "_c"})
    extreme = F.when(buy, F.col("_h")).otherwise(F.col("_l"))
    beyond = F.when(buy, F.col("_c") > F.col("price_level")).otherwise(F.col("_c") < F.col("price_level"))
    return hit.select(*KEY, "level_id", "liquidity_type", "side", "event_timestamp", "confirmation_timestamp", "price_level", extreme.alias("extreme_price"), (F.abs(extreme - F.col("price_level")) / point_of()).alias("penetration_points"), beyond.alias("closed_beyond"), (~beyond).alias("is_rejection"), F.col("hit_idx").alias("idx"))


def approaches(levels: DataFrame, bars: DataFrame, swept: DataFrame, tolerance_points: float) -> DataFrame:
    """The first bar that comes within tolerance of a level before the bar that sweeps it."""
    lv = first_index_at(levels, bars, "confirmation_timestamp", "close_time", "_s").filter("_s IS NOT NULL")
    buy = F.col("side") == BUY
    tol = tolerance_points * point_of()
    lv = lv.withColumn("_above", buy).withColumn("_level", F.when(buy, F.col("price_level") - tol).otherwise(F.col("price_level") + tol))
    hit = first_hit_two_sided(lv, bars, F.col("high"), F.col("low"), "_s", "_level", "_above", inclusive=True).filter("hit_idx IS NOT NULL")
    hit = hit.join(swept.select("level_id", F.col("idx").alias("_swept")), "level_id", "left").filter("_swept IS NULL OR hit_idx < _swept")
    return bars_at(hit, bars, "hit_idx", {"close_time": "approached_at"}).select(*KEY, "level_id", "approached_at")


def level_status(levels: DataFrame, swept: DataFrame, as_of=None, approached: DataFrame | None = None) -> DataFrame:
    """swept, approached or active; pending if as_of is before the confirmation."""
    rows = levels.join(swept.select("level_id", F.col("confirmation_timestamp").alias("swept_at")), "level_id", "left")
    rows = rows.join(approached.select("level_id", "approached_at"), "level_id", "left") if approached is not None else rows.withColumn("approached_at", F.lit(None).cast("timestamp"))
    seen = lambda c: F.col(c).isNotNull() if as_of is None else F.col(c) <= F.lit(as_of).cast("timestamp")
    return rows.withColumn("status", F.when(~seen("confirmation_timestamp"), "pending").when(seen("swept_at"), "swept").when(seen("approached_at"), "approached").otherwise("active"))
