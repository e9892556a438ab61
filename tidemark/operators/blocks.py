"""Runs of candles and what grows out of them: order blocks, breakers, unicorns, CISD."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.gaps import zone_id
from tidemark.operators.search import bars_at, fill_stream, first_hit_two_sided, first_index_at
from tidemark.operators.swings import displacement, stamp
from tidemark.schema import BEAR, BULL, KEY, Timeframe, block_window, framed, point_of


@dataclass(frozen=True)
class OrderBlockConfig:
    grouping: str = "multi_candle_group"
    geometry: str = "full_range"
    break_tolerance_points: float = 0.0
    max_bars_to_confirm: int = 50
    require_contiguous: bool = True
    require_fvg: bool = False
    require_displacement: bool = False
    displacement_lookback: int = 20
    displacement_factor: float = 1.5


@dataclass(frozen=True)
class BreakerConfig:
    wick: bool = False
    max_bars: int = 20


@dataclass(frozen=True)
class UnicornConfig:
    max_bars: int = 50


@dataclass(frozen=True)
class CisdConfig:
    anchor: str = "series_open"
    max_bars: int = 50
    require_contiguous: bool = True
    min_leg: int = 1
    tolerance_points: float = 0.0


def runs(bars: DataFrame, require_contiguous: bool = True) -> DataFrame:
    """Bars of the longest stretches of one direction, with run (its first idx); a bar
    that closes where it opened belongs to none and ends one."""
    w = block_window()
    way = F.signum(F.col("close") - F.col("open"))
    rows = framed(bars, 1, 0).withColumn("way", way)
    apart = F.lag("close_time").over(w) != F.col("timestamp") if require_contiguous else F.lit(False)
    new = F.lag("way").over(w).isNull() | (F.lag("way").over(w) != F.col("way")) | apart
    rows = rows.withColumn("_new", F.when(new, F.col("idx"))).filter("_own").drop("_own")
    # A block without a start of its own goes on with the last start of the blocks before.
    earlier = Window.partitionBy(*KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*KEY, "_block").agg(F.max("_new").alias("_new")).select(*KEY, "_block", F.last("_new", ignorenulls=True).over(earlier).alias("_before"))
    rows = rows.withColumn("run", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(starts, [*KEY, "_block"], "left")
    return rows.withColumn("run", F.coalesce("run", "_before")).filter("way <> 0").drop("_new", "_before", "_block")


def order_blocks(bars: DataFrame, zones: DataFrame, config: OrderBlockConfig = OrderBlockConfig()) -> DataFrame:
    """The last opposite run before a close beyond its range, within max_bars_to_confirm."""
    r = runs(bars, config.require_contiguous)
    body = config.geometry == "body"
    r = r.withColumn("_hi", F.greatest("open", "close") if body else F.col("high")).withColumn("_lo", F.least("open", "close") if body else F.col("low"))
    by = F.struct("_hi", "_lo", "timestamp")
    g = r.groupBy(*KEY, "run", "way").agg(F.max("_hi").alias("top"), F.min("_lo").alias("bottom"), F.min("timestamp").alias("event_timestamp"), F.max("timestamp").alias("_leg_start"), F.max("idx").alias("_end"), F.count("*").cast("int").alias("candle_count"), F.max_by(by, "idx").alias("_last"))
    if config.grouping == "single_candle":
        g = g.withColumns({"top": F.col("_last._hi"), "bottom": F.col("_last._lo"), "event_timestamp": F.col("_last.timestamp"), "candle_count": F.lit(1)})
    g = g.filter("top > bottom").withColumn("direction", F.when(F.col("way") < 0, BULL).otherwise(BEAR)).withColumn("_s", F.col("_end") + 1).withColumn("_above", F.col("way") < 0)
    tol = config.break_tolerance_points * point_of()
    g = g.withColumn("_level", F.when(F.col("_above"), F.col("top") + tol).otherwise(F.col("bottom") - tol))
    hit = first_hit_two_sided(g, bars, F.col("close"), F.col("close"), "_s", "_level", "_above").filter(F.col("hit_idx") <= F.col("_end") + config.max_bars_to_confirm)
    wide = displacement(bars, config.displacement_lookback)
    hit = bars_at(hit, wide, "hit_idx", {"timestamp": "break_bar_timestamp", "close_time": "confirmation_timestamp", "close": "break_close", "ratio": "_ratio"})
    if config.require_displacement:
        hit = hit.filter(F.col("_ratio").isNotNull() & ~F.isnan("_ratio") & (F.col("_ratio") >= config.displacement_factor)).withColumn("displacement_ratio", F.col("_ratio"))
    else:
        hit = hit.withColumn("displacement_ratio", F.lit(None).cast("double"))
    hit = hit.withColumn("bars_to_confirm", (F.col("hit_idx") - F.col("_end")).cast("int")).withColumn("order_block_id", zone_id("ob", "direction", stamp("event_timestamp")))
    # A gap that formed inside the leg has its third bar among at most max_bars_to_confirm bars.
    legs = hit.select(*KEY, "direction", "order_block_id", "_leg_start", "confirmation_timestamp", F.explode(F.sequence(F.col("_end") + 1, F.col("hit_idx"))).alias("idx"))
    z = zones.select(*KEY, "direction", "idx", "zone_id", "formation_timestamp", F.col("confirmation_timestamp").alias("_zc"))
    found = legs.join(z, [*KEY, "direction", "idx"]).filter((F.col("formation_timestamp") >= F.col("_leg_start")) & (F.col("_zc") >= F.col("_leg_start")) & (F.col("_zc") <= F.col("confirmation_timestamp")))
    found = found.groupBy("order_block_id").agg(F.min_by("zone_id", "idx").alias("related_fvg_id"))
    out = hit.join(found, "order_block_id", "left")
    if config.require_fvg:
        out = out.filter(F.col("related_fvg_id").isNotNull())
    return out.select(*KEY, "order_block_id", "direction", "top", "bottom", "event_timestamp", "confirmation_timestamp", "break_bar_timestamp", "break_close", "bars_to_confirm", "displacement_ratio", "related_fvg_id", "candle_count", F.col("hit_idx").alias("idx"))


def failures(blocks: DataFrame, bars: DataFrame, id_: str = "order_block_id", wick: bool = False) -> DataFrame:
    """The first bar at or after confirmation that is beyond a block's far edge."""
    b = first_index_at(blocks, bars, "confirmation_timestamp", out="_s").filter("_s IS NOT NULL")
    bull = F.col("direction") == BULL
    b = b.withColumn("_level", F.when(bull, F.col("bottom")).otherwise(F.col("top"))).withColumn("_above", ~bull)
    up, down = (F.col("high"), F.col("low")) if wick else (F.col("close"), F.col("close"))
    hit = first_hit_two_sided(b.select(*KEY, id_, "_s", "_level", "_above"), bars, up, down, "_s", "_level", "_above", out="failure_idx").filter("failure_idx IS NOT NULL")
    return bars_at(hit, bars, "failure_idx", {"timestamp": "failure_timestamp", "close_time": "failed_at", "close": "failure_close"}).select(*KEY, id_, "failure_idx", "failure_timestamp", "failed_at", "failure_close")


def zone_fills(zones: DataFrame, bars: DataFrame, id_: str, partial: float = 0.0, full: float = 1.0) -> DataFrame:
    """Fill progress from the first bar that opens at or after a zone's confirmation."""
    z = first_index_at(zones, bars, "confirmation_timestamp", out="_s")
    return fill_stream(z, bars, id_, "_s", partial, full)


def block_status(blocks: DataFrame, fills: DataFrame, failed: DataFrame, as_of=None) -> DataFrame:
    """invalidated over mitigated over partially_filled over active."""
    if as_of is not None:
        t = F.lit(as_of).cast("timestamp")
        blocks, fills, failed = blocks.filter(F.col("confirmation_timestamp") <= t), fills.filter(F.col("confirmation_timestamp") <= t), failed.filter(F.col("failed_at") <= t)
    deepest = fills.groupBy("zone_id").agg(F.max_by("status_after", "idx").alias("_fill"))
    rows = blocks.join(deepest, blocks["order_block_id"] == deepest["zone_id"], "left").drop("zone_id").join(failed.select("order_block_id", "failed_at"), "order_block_id", "left")
    return rows.withColumn("status", F.when(F.col("failed_at").isNotNull(), "invalidated").otherwise(F.coalesce("_fill", F.lit("active")))).drop("_fill")


def breakers(blocks: DataFrame, failed: DataFrame, breaks: DataFrame | None, bars: DataFrame, require_structure: bool = True, max_bars: int = 20) -> DataFrame:
    """Failed order blocks turned around; by default only with a structure break of the new
    direction that confirms from the failing close to max_bars bars later."""
    if require_structure:
        b = blocks.join(failed.drop(*KEY), "order_block_id").withColumn("_new", F.when(F.col("direction") == BULL, BEAR).otherwise(BULL))
        b = b.withColumn("_at", F.explode(F.sequence(F.col("failure_idx"), F.col("failure_idx") + max_bars)))
        s = breaks.select(*KEY, F.col("direction").alias("_new"), F.col("idx").alias("_at"), "break_id", F.col("confirmation_timestamp").alias("_bc"))
        hit = b.join(s, [*KEY, "_new", "_at"]).groupBy("order_block_id").agg(F.min_by(F.struct("break_id", "_bc"), "_at").alias("_s")).select("order_block_id", "_s.*")
        rows = blocks.join(failed.drop(*KEY), "order_block_id").join(hit, "order_block_id")
        trigger = F.col("_bc")
    else:
        rows = blocks.join(failed.drop(*KEY), "order_block_id").withColumn("break_id", F.lit(None).cast("string"))
        trigger = F.col("failed_at")
    turned = F.when(F.col("direction") == BULL, BEAR).otherwise(BULL)
    rows = rows.withColumn("_c", F.greatest("confirmation_timestamp", trigger))
    return rows.select(*KEY, zone_id("breaker", turned, stamp("failure_timestamp"), "order_block_id").alias("breaker_id"), turned.alias("direction"), "top", "bottom", F.col("order_block_id").alias("source_order_block_id"), "break_id", F.col("failure_timestamp").alias("event_timestamp"), F.col("_c").alias("confirmation_timestamp"), "failed_at", "failure_close")


def failed_without_structure(failed: DataFrame, made: DataFrame) -> DataFrame:
    """Blocks that failed and became no breaker."""
    return failed.join(made.select(F.col("source_order_block_id").alias("order_block_id")), "order_block_id", "left_anti")


def unicorns(made: DataFrame, zones: DataFrame, tf: Timeframe, max_bars: int = 50) -> DataFrame:
    """A breaker and a gap of its direction that strictly overlap, at most max_bars apart."""
    span = tf.minutes * 60 * max_bars
    t = F.unix_seconds("confirmation_timestamp")
    a = made.withColumn("_cell", F.floor(t / span)).select(*KEY, "direction", "_cell", *[F.col(c).alias(f"b_{c}") for c in ("breaker_id", "source_order_block_id", "top", "bottom", "event_timestamp", "confirmation_timestamp")])
    b = zones.withColumn("_cell", F.explode(F.array(*[F.floor(t / span) + d for d in (-1, 0, 1)]))).select(*KEY, "direction", "_cell", *[F.col(c).alias(f"z_{c}") for c in ("zone_id", "top", "bottom", "event_timestamp", "confirmation_timestamp")])
    p = a.join(b, [*KEY, "direction", "_cell"]).withColumn("top", F.least("b_top", "z_top")).withColumn("bottom", F.greatest("b_bottom", "z_bottom"))
    gap = F.abs(F.unix_seconds("b_confirmation_timestamp") - F.unix_seconds("z_confirmation_timestamp"))
    p = p.withColumn("bars_between", F.floor(gap / (tf.minutes * 60)).cast("int")).filter((F.col("top") > F.col("bottom")) & (F.col("bars_between") <= max_bars))
    p = p.withColumn("_c", F.greatest("b_confirmation_timestamp", "z_confirmation_timestamp"))
    inside = (F.col("z_top") <= F.col("b_top")) & (F.col("z_bottom") >= F.col("b_bottom"))
    return p.select(
        *KEY, F.concat_ws("|", zone_id("unicorn", stamp("_c"), "b_breaker_id"), "z_zone_id").alias("unicorn_id"), "direction", "top", "bottom", F.col("b_breaker_id").alias("source_breaker_id"), F.col("z_zone_id").alias("source_fvg_id"), F.col("b_source_order_block_id").alias("source_order_block_id"),
        F.greatest("b_event_timestamp", "z_event_timestamp").alias("event_timestamp"), F.greatest("b_confirmation_timestamp", "z_confirmation_timestamp").alias("confirmation_timestamp"), inside.alias("fully_contained"), "bars_between",
    )


def cisd(bars: DataFrame, anchor: str = "series_open", max_bars: int = 50, require_contiguous: bool = True, min_leg: int = 1, tolerance_points: float = 0.0) -> DataFrame:
    """A close beyond the open of the run that delivered there; only changes of state."""
    r = runs(bars, require_contiguous)
    far = F.when(F.col("way") < 0, F.max("open").over(Window.partitionBy(*KEY, "run"))).otherwise(F.min("open").over(Window.partitionBy(*KEY, "run")))
    g = r.withColumn("_far", far).groupBy(*KEY, "run", "way").agg(F.min_by("open", "idx").alias("_open"), F.first("_far").alias("_far"), F.min("timestamp").alias("leg_start_timestamp"), F.max("timestamp").alias("leg_end_timestamp"), F.max("idx").alias("_end"), F.count("*").cast("int").alias("leg_length"))
    g = g.filter(F.col("leg_length") >= min_leg)
    tol = tolerance_points * point_of()
    g = g.withColumn("trigger_level", F.col("_open") if anchor == "series_open" else F.col("_far")).withColumn("_s", F.col("_end") + 1).withColumn("_above", F.col("way") < 0)
    g = g.withColumn("_level", F.when(F.col("_above"), F.col("trigger_level") + tol).otherwise(F.col("trigger_level") - tol))
    hit = first_hit_two_sided(g, bars, F.col("close"), F.col("close"), "_s", "_level", "_above").filter(F.col("hit_idx") <= F.col("_end") + max_bars)
    hit = hit.withColumn("direction", F.when(F.col("_above"), BULL).otherwise(BEAR))
    before = F.lag("direction").over(Window.partitionBy(*KEY).orderBy("hit_idx", "run"))
    hit = hit.withColumn("previous_state", F.coalesce(before, F.lit("undefined"))).filter("previous_state <> direction")
    hit = bars_at(hit, bars, "hit_idx", {"timestamp": "event_timestamp", "close_time": "confirmation_timestamp", "close": "trigger_close"})
    return hit.select(*KEY, zone_id("cisd", "direction", stamp("event_timestamp")).alias("cisd_id"), "direction", "previous_state", F.col("direction").alias("resulting_state"), "event_timestamp", "confirmation_timestamp", "trigger_level", "trigger_close", "leg_start_timestamp", "leg_end_timestamp", "leg_length", F.col("hit_idx").alias("idx"))
