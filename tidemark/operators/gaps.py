"""Price gaps and what becomes of them: FVG, IFVG, BPR and the four-bar RDRB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import bars_at, fill_stream, first_hit_two_sided
from tidemark.operators.swings import range_ratio, stamp
from tidemark.schema import BEAR, BULL, KEY, NEUTRAL, Timeframe, block_window, framed, own, point_of


@dataclass(frozen=True)
class FvgConfig:
    min_size_points: float = 0.0
    measure: str = "wick"
    require_contiguous: bool = True
    require_displacement: bool = False
    displacement_lookback: int = 20
    displacement_factor: float = 1.5
    partial_fill_threshold: float = 0.0
    full_fill_threshold: float = 1.0


def zone_id(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *KEY, *parts)


def fvg_zones(bars: DataFrame, config: FvgConfig = FvgConfig()) -> DataFrame:
    """Three bars whose outer two leave a gap, confirmed at the third's close."""
    w = block_window()
    rows = framed(bars, config.displacement_lookback + 2, 0).withColumn("ratio", range_ratio(w, config.displacement_lookback))
    body = config.measure == "body"
    top, low = (F.greatest("open", "close"), F.least("open", "close")) if body else (F.col("high"), F.col("low"))
    rows = rows.withColumns({"_h1": F.lag(top, 2).over(w), "_l1": F.lag(low, 2).over(w), "_t1": F.lag("timestamp", 2).over(w), "_c1": F.lag("close_time", 2).over(w), "_t2": F.lag("timestamp", 1).over(w), "_c2": F.lag("close_time", 1).over(w), "_ratio": F.lag("ratio", 1).over(w), "_h3": top, "_l3": low})
    size = config.min_size_points * point_of()
    up, down = F.col("_l3") - F.col("_h1"), F.col("_l1") - F.col("_h3")
    rows = own(rows).filter(F.col("_t1").isNotNull())
    if config.require_contiguous:
        rows = rows.filter((F.col("_c1") == F.col("_t2")) & (F.col("_c2") == F.col("timestamp")))
    if config.require_displacement:
        rows = rows.filter(F.col("_ratio").isNotNull() & ~F.isnan("_ratio") & (F.col("_ratio") >= config.displacement_factor))
    bull, bear = (F.col("_l3") > F.col("_h1")) & (up > size), (F.col("_h3") < F.col("_l1")) & (down > size)
    rows = rows.withColumn("direction", F.when(bull, BULL).when(bear, BEAR)).filter("direction IS NOT NULL")
    is_bull = F.col("direction") == BULL
    return rows.select(
        *KEY, "direction", F.when(is_bull, F.col("_l3")).otherwise(F.col("_l1")).alias("top"), F.when(is_bull, F.col("_h1")).otherwise(F.col("_h3")).alias("bottom"),
        F.col("_t1").alias("event_timestamp"), F.col("_t2").alias("formation_timestamp"), F.col("close_time").alias("confirmation_timestamp"), "idx", zone_id("fvg", "direction", stamp("_t2")).alias("zone_id"),
    )


def fvg_fills(zones: DataFrame, bars: DataFrame, config: FvgConfig = FvgConfig()) -> DataFrame:
    """Fill progress; a gap cannot be filled by the bars that made it."""
    return fill_stream(zones.withColumn("_s", F.col("idx") + 1), bars, "zone_id", "_s", config.partial_fill_threshold, config.full_fill_threshold)


TRIGGERS, POLARITIES = ("close_through_far_edge", "close_inside_zone", "wick_through"), ("later", "neutral")


@dataclass(frozen=True)
class IfvgConfig:
    trigger: str = "close_through_far_edge"
    max_bars: int = 500

    def __post_init__(self) -> None:
        if self.trigger not in TRIGGERS:
            raise ValueError(f"trigger must be one of {TRIGGERS}")


@dataclass(frozen=True)
class BprConfig:
    max_bars: int = 100
    polarity: str = "later"

    def __post_init__(self) -> None:
        if self.polarity not in POLARITIES:
            raise ValueError(f"polarity must be one of {POLARITIES}")


def ifvg(zones: DataFrame, bars: DataFrame, trigger: str = "close_through_far_edge", max_bars: int = 500) -> DataFrame:
    """Gaps inverted by a bar within max_bars of their third: polarity turns, one each."""
    bull = F.col("direction") == BULL
    z = zones.withColumn("_s", F.col("idx") + 1).withColumn("_above", ~bull)
    far, near = F.when(bull, F.col("bottom")).otherwise(F.col("top")), F.when(bull, F.col("top")).otherwise(F.col("bottom"))
    z = z.withColumn("_level", near if trigger == "close_inside_zone" else far)
    up, down = (F.col("high"), F.col("low")) if trigger == "wick_through" else (F.col("close"), F.col("close"))
    hit = first_hit_two_sided(z, bars, up, down, "_s", "_level", "_above").filter(F.col("hit_idx") <= F.col("idx") + max_bars)
    hit = hit.withColumn("bars_to_invert", (F.col("hit_idx") - F.col("idx")).cast("int"))
    hit = bars_at(hit, bars, "hit_idx", {"timestamp": "trigger_timestamp", "close_time": "_confirm", "close": "trigger_close"})
    return hit.select(
        *KEY, F.when(bull, BEAR).otherwise(BULL).alias("direction"), "top", "bottom", F.col("zone_id").alias("source_fvg_id"), F.col("trigger_timestamp").alias("event_timestamp"), F.col("_confirm").alias("confirmation_timestamp"), "trigger_close", "bars_to_invert",
        F.col("hit_idx").alias("idx"), zone_id("ifvg", stamp("trigger_timestamp"), "zone_id").alias("ifvg_id"),
    )


def mitigated_without_inversion(fills: DataFrame, inverted: DataFrame) -> DataFrame:
    """Filled gaps that never inverted."""
    return fills.filter("status_after = 'mitigated'").select(*KEY, "zone_id").join(inverted.select(F.col("source_fvg_id").alias("zone_id")), "zone_id", "left_anti")


def bpr(zones: DataFrame, tf: Timeframe, max_bars: int = 100, polarity: str = "later") -> DataFrame:
    """Where an upward and a downward gap strictly overlap, confirmed with the later.

    Pairs meet by stretches of max_bars bars of time: only neighbouring stretches can
    hold pairs close enough, so the join is on equal stretch numbers."""
    span = tf.minutes * 60 * max_bars
    t = F.unix_seconds("confirmation_timestamp")
    up = zones.filter(F.col("direction") == BULL).withColumn("_cell", F.floor(t / span))
    down = zones.filter(F.col("direction") == BEAR).withColumn("_cell", F.explode(F.array(*[F.floor(t / span) + d for d in (-1, 0, 1)])))
    cols = ("zone_id", "top", "bottom", "event_timestamp", "confirmation_timestamp")
    a = up.select(*KEY, "_cell", *[F.col(c).alias(f"u_{c}") for c in cols])
    b = down.select(*KEY, "_cell", *[F.col(c).alias(f"d_{c}") for c in cols])
    p = a.join(b, [*KEY, "_cell"])
    p = p.withColumn("top", F.least("u_top", "d_top")).withColumn("bottom", F.greatest("u_bottom", "d_bottom"))
    gap = F.abs(F.unix_seconds("u_confirmation_timestamp") - F.unix_seconds("d_confirmation_timestamp"))
    p = p.withColumn("bars_between", F.floor(gap / (tf.minutes * 60)).cast("int")).filter((F.col("top") > F.col("bottom")) & (F.col("bars_between") <= max_bars))
    later = F.when(F.col("u_confirmation_timestamp") >= F.col("d_confirmation_timestamp"), BULL).otherwise(BEAR)
    return p.select(
        *KEY, (later if polarity == "later" else F.lit(NEUTRAL)).alias("direction"), "top", "bottom", F.col("u_zone_id").alias("bullish_fvg_id"), F.col("d_zone_id").alias("bearish_fvg_id"),
        F.greatest("u_event_timestamp", "d_event_timestamp").alias("event_timestamp"), F.greatest("u_confirmation_timestamp", "d_confirmation_timestamp").alias("confirmation_timestamp"), "bars_between", F.concat_ws("|", F.lit("bpr"), "u_zone_id", "d_zone_id").alias("bpr_id"),
    )


@dataclass(frozen=True)
class RdrbConfig:
    tolerance_points: float = 0.0
    require_directional_c1: bool = True
    require_directional_c2: bool = True
    require_directional_c3: bool = False
    require_directional_c4: bool = True
    require_contiguous: bool = True


def rdrb(bars: DataFrame, config: RdrbConfig = RdrbConfig()) -> DataFrame:
    """Four neighbouring bars of one direction whose fourth clears the second."""
    w = block_window()
    cols = {}
    for c in ("open", "high", "low", "close", "timestamp", "close_time"):
        for i in (1, 2, 3):
            cols[f"{c}{i}"] = F.lag(c, 4 - i).over(w)
        cols[f"{c}4"] = F.col(c)
    rows = own(framed(bars, 3, 0).withColumns(cols)).filter(F.col("timestamp1").isNotNull())
    if config.require_contiguous:
        rows = rows.filter((F.col("close_time1") == F.col("timestamp2")) & (F.col("close_time2") == F.col("timestamp3")) & (F.col("close_time3") == F.col("timestamp4")))
    tol = config.tolerance_points * point_of()

    def moves(up: bool) -> Column:
        ok = F.lit(True)
        for i in (1, 2, 3, 4):
            if getattr(config, f"require_directional_c{i}"):
                ok = ok & (F.col(f"close{i}") > F.col(f"open{i}") if up else F.col(f"close{i}") < F.col(f"open{i}"))
        return ok & ((F.col("low4") - F.col("low2") > tol) if up else (F.col("high2") - F.col("high4") > tol))

    one = lambda d, top, bottom: F.struct(F.lit(d).alias("direction"), F.col(top).alias("top"), F.col(bottom).alias("bottom"))
    found = F.array_compact(F.array(F.when(moves(True), one(BULL, "low4", "low2")), F.when(moves(False), one(BEAR, "high2", "high4"))))
    rows = rows.withColumn("z", F.explode(found))
    return rows.select(*KEY, "z.*", F.col("timestamp1").alias("event_timestamp"), F.col("close_time4").alias("confirmation_timestamp"), "idx").withColumn("rdrb_id", zone_id("rdrb", "direction", stamp("event_timestamp")))
