"""Dealing ranges: the broken swing and the latest opposite one, and where price lies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.schema import BULL, KEY, point_of


@dataclass(frozen=True)
class RangeConfig:
    tolerance_points: float = 0.5


def candidates(breaks: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each break with its two anchors; verdict missing, inverted, unchanged or range.

    Every swing confirms a fixed number of bars after it, so of the opposite swings that
    are confirmed by the break's bar, all but possibly those later on the chart qualify;
    the join is as of the instant before which both hold."""
    p = pivots.select(*KEY, "direction", F.col("swing_id").alias("o_id"), F.col("price_level").alias("o_price"), F.col("confirmation_timestamp").alias("o_confirmed"), F.col("event_timestamp").alias("o_event"))
    b = breaks.withColumn("_want", F.when(F.col("direction") == BULL, "bearish").otherwise("bullish"))
    p = p.withColumnRenamed("direction", "_want")
    rows = asof_join(b, p, "confirmation_timestamp", "o_confirmed", ["o_id", "o_price", "o_confirmed", "o_event"], [F.col("o_event")], by=(*KEY, "_want"))
    rows = rows.withColumn("_bull", F.col("direction") == BULL)
    rows = rows.withColumn("high_price", F.when(F.col("_bull"), F.col("reference_level")).otherwise(F.col("o_price"))).withColumn("low_price", F.when(F.col("_bull"), F.col("o_price")).otherwise(F.col("reference_level")))
    rows = rows.withColumn("high_source_id", F.when(F.col("_bull"), F.col("swing_id")).otherwise(F.col("o_id"))).withColumn("low_source_id", F.when(F.col("_bull"), F.col("o_id")).otherwise(F.col("swing_id")))
    rows = rows.withColumn("verdict", F.when(F.col("o_id").isNull(), "missing").when(F.col("high_price") <= F.col("low_price"), "inverted"))
    anchors = F.when(F.col("verdict").isNull(), F.struct("high_source_id", "low_source_id"))
    rows = rows.withColumn("_a", anchors)
    order = Window.partitionBy(*KEY).orderBy("confirmation_timestamp", "event_timestamp").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_a", ignorenulls=True).over(order)
    return rows.withColumn("verdict", F.coalesce("verdict", F.when(before == F.col("_a"), "unchanged").otherwise("range"))).drop("_a")


def dealing_ranges(breaks: DataFrame, pivots: DataFrame) -> DataFrame:
    rows = candidates(breaks, pivots).filter("verdict = 'range'")
    confirmed = F.greatest("confirmation_timestamp", "reference_swing_confirmation", "o_confirmed")
    out = rows.select(
        *KEY, "direction", "high_price", "low_price", ((F.col("high_price") + F.col("low_price")) / 2).alias("equilibrium_price"), "high_source_id", "low_source_id", F.col("break_id").alias("source_break_id"), "event_timestamp", confirmed.alias("confirmation_timestamp"),
    )
    out = out.withColumn("range_id", F.concat_ws(":", F.lit("range"), *KEY, "direction", F.date_format("confirmation_timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.concat_ws("|", "high_source_id", "low_source_id")))
    return out.withColumn("superseded_at", F.lead("confirmation_timestamp").over(Window.partitionBy(*KEY).orderBy("confirmation_timestamp", "range_id")))


def rejections(breaks: DataFrame, pivots: DataFrame) -> DataFrame:
    """Per series: ranges made, and breaks without one by reason."""
    return candidates(breaks, pivots).groupBy(*KEY).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("range", "missing", "inverted", "unchanged")])


def zone_of(price: Column, equilibrium: Column, tolerance_points: float = 0.5) -> Column:
    d = price - equilibrium
    return F.when(F.abs(d) <= tolerance_points * point_of(), "equilibrium").when(d > 0, "premium").when(d < 0, "discount")


def observations(bars: DataFrame, ranges: DataFrame, tolerance_points: float = 0.5) -> DataFrame:
    """Each bar from a range's confirmation to the next one's, against that range."""
    cols = ["range_id", "range_direction", "high_price", "low_price", "equilibrium_price", "range_confirmed"]
    r = ranges.withColumn("range_direction", F.col("direction")).withColumn("range_confirmed", F.col("confirmation_timestamp")).select(*KEY, *cols)
    rows = asof_join(bars, r, "close_time", "range_confirmed", cols, [F.col("range_id")]).filter("range_id IS NOT NULL")
    width = F.col("high_price") - F.col("low_price")
    return rows.select(
        *KEY, F.col("timestamp").alias("observation_timestamp"), F.col("close_time").alias("confirmation_timestamp"), "range_id", "range_direction", "high_price", "low_price", "equilibrium_price", F.col("close").alias("price"), zone_of(F.col("close"), F.col("equilibrium_price"), tolerance_points).alias("zone"),
        (F.col("close") - F.col("equilibrium_price")).alias("distance_from_equilibrium"), F.try_divide(F.col("close") - F.col("low_price"), width).alias("percentage_position"),
    )
