"""Swing pivots, their labels, and structure breaks.

All frames carry idx and close_time (schema.prepared). Windows are positional: they
count bars that exist, not time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import AsOf, asof_joins
from tidemark.schema import BEAR, BULL, KEY, block_window, framed, own, point_of

TIE_POLICIES = ("first", "last", "strict", "all")


@dataclass(frozen=True)
class SwingConfig:
    left: int = 2
    right: int = 2
    tie_policy: str = "first"

    def __post_init__(self) -> None:
        if self.left < 1 or self.right < 1:
            raise ValueError("left and right must be at least 1")
        if self.tie_policy not in TIE_POLICIES:
            raise ValueError(f"tie_policy must be one of {TIE_POLICIES}")


@dataclass(frozen=True)
class StructureConfig:
    break_mode: str = "close"
    choch_policy: str = "distinct_by_displacement"
    break_tolerance_points: float = 0.0
    equal_level_tolerance_points: float = 0.0
    min_swing_strength_points: float = 0.0
    displacement_lookback: int = 20
    displacement_factor: float = 1.5


def stamp(c: str) -> Column:
    """A timestamp as ids spell it."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def range_ratio(w, lookback: int) -> Column:
    """Range of a bar over the mean range of the `lookback` bars before it; null without
    a full complement, NaN for 0/0 and infinity for x/0."""
    w = w.rowsBetween(-lookback, -1)
    size = F.col("high") - F.col("low")
    mean = F.when(F.count("high").over(w) == lookback, F.avg(size).over(w))
    return F.when(mean == 0, F.when(size == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(size, mean))


def displacement(bars: DataFrame, lookback: int = 20, out: str = "ratio") -> DataFrame:
    """Bars with range_ratio."""
    return own(framed(bars, lookback, 0).withColumn(out, range_ratio(block_window(), lookback)))


def swings(bars: DataFrame, config: SwingConfig = SwingConfig()) -> DataFrame:
    """A bar whose extreme beats `left` bars before and `right` after, confirmed at the
    close of the last of those. One bar may be both a high and a low."""
    n, m = config.left, config.right
    w = block_window()
    before, after = w.rowsBetween(-n, -1), w.rowsBetween(1, m)
    full = (F.count("high").over(before) == n) & (F.count("high").over(after) == m)
    rows = framed(bars, n, m).withColumns(
        {
            "_full": full, "_hb": F.max("high").over(before), "_ha": F.max("high").over(after), "_lb": F.min("low").over(before), "_la": F.min("low").over(after),
            "confirmation_timestamp": F.lead("close_time", m).over(w),
        }
    ).filter("_own AND _full")
    tie_before, tie_after = config.tie_policy in ("last", "all"), config.tie_policy in ("first", "all")
    high, low = F.col("high"), F.col("low")
    is_high = (high >= F.col("_hb") if tie_before else high > F.col("_hb")) & (high >= F.col("_ha") if tie_after else high > F.col("_ha"))
    is_low = (low <= F.col("_lb") if tie_before else low < F.col("_lb")) & (low <= F.col("_la") if tie_after else low < F.col("_la"))
    one = lambda kind, price, ref, gap: F.struct(F.lit(kind).alias("direction"), price.alias("price_level"), ref.alias("reference_level"), gap.alias("prominence"))
    ref_h, ref_l = F.greatest("_hb", "_ha"), F.least("_lb", "_la")
    both = F.array_compact(F.array(F.when(is_high, one(BULL, high, ref_h, high - ref_h)), F.when(is_low, one(BEAR, low, ref_l, ref_l - low))))
    out = rows.select(*KEY, "idx", F.col("timestamp").alias("event_timestamp"), "confirmation_timestamp", F.explode(both).alias("s")).select(*KEY, "idx", "event_timestamp", "confirmation_timestamp", "s.*")
    out = out.withColumn("strength", F.col("prominence") / point_of()).drop("prominence")
    return out.withColumn("swing_id", F.concat_ws(":", F.lit("swing"), *KEY, "direction", stamp("event_timestamp")))


def swing_labels(pivots: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """Higher or lower than the swing of the same kind confirmed before; equal levels
    get no label but become the one before."""
    w = Window.partitionBy(*KEY, "direction").orderBy("confirmation_timestamp", "event_timestamp")
    rows = pivots.filter(F.col("strength") >= config.min_swing_strength_points).withColumn("_b", F.lag(F.struct("event_timestamp", "confirmation_timestamp", "price_level")).over(w))
    delta = F.col("price_level") - F.col("_b.price_level")
    rows = rows.withColumn("_d", delta).filter(F.abs("_d") > config.equal_level_tolerance_points * point_of())
    up = F.col("_d") > 0
    label = F.when(F.col("direction") == BULL, F.when(up, "higher_high").otherwise("lower_high")).otherwise(F.when(up, "higher_low").otherwise("lower_low"))
    return rows.select(
        *KEY, label.alias("label"), F.when(up, BULL).otherwise(BEAR).alias("direction"), "event_timestamp", F.greatest("confirmation_timestamp", "_b.confirmation_timestamp").alias("confirmation_timestamp"),
        "price_level", F.col("_b.price_level").alias("reference_level"), (F.abs("_d") / point_of()).alias("strength"), F.col("_b.event_timestamp").alias("previous_swing_timestamp"),
    )


def structure_breaks(bars: DataFrame, pivots: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """Breaks of the last confirmed swing on each side.

    A swing is the reference from the first bar that closes at or after its confirmation
    until the next of its side is. Those stretches don't overlap, so each bar has one
    reference per side and a break is the first bar of the stretch that is beyond it.
    Upward breaks come first: a bar that makes one makes no downward break."""
    good = pivots.filter(F.col("strength") >= config.min_swing_strength_points)
    tol = config.break_tolerance_points * point_of()
    ref = ["swing_id", "price_level", "event_timestamp", "confirmation_timestamp"]
    rows = displacement(bars, config.displacement_lookback)
    sides = []
    for side, kind in (("h", BULL), ("l", BEAR)):
        names = {c: f"_{side}_{c}" for c in ref}
        part = good.filter(F.col("direction") == kind).select(*KEY, *[F.col(c).alias(n) for c, n in names.items()])
        sides.append(AsOf(part, names["confirmation_timestamp"], list(names.values()), [F.col(names["event_timestamp"])]))
    rows = asof_joins(rows, "close_time", sides)
    probe_up, probe_down = (F.col("close"), F.col("close")) if config.break_mode == "close" else (F.col("high"), F.col("low"))
    rows = rows.withColumn("_up", probe_up > F.col("_h_price_level") + tol).withColumn("_down", probe_down < F.col("_l_price_level") - tol)
    first = lambda side: Window.partitionBy(*KEY, f"_{side}_swing_id")
    rows = rows.withColumn("_bull", F.coalesce(F.col("_up") & (F.col("idx") == F.min(F.when(F.col("_up"), F.col("idx"))).over(first("h"))), F.lit(False)))
    rows = rows.withColumn("_down", F.col("_down") & ~F.col("_bull"))
    rows = rows.withColumn("_bear", F.coalesce(F.col("_down") & (F.col("idx") == F.min(F.when(F.col("_down"), F.col("idx"))).over(first("l"))), F.lit(False)))
    hit = rows.filter("_bull OR _bear")
    side = lambda c: F.when(F.col("_bull"), F.col(f"_h_{c}")).otherwise(F.col(f"_l_{c}"))
    probe = F.when(F.col("_bull"), probe_up).otherwise(probe_down)
    hit = hit.select(
        *KEY, F.when(F.col("_bull"), BULL).otherwise(BEAR).alias("direction"), F.col("timestamp").alias("event_timestamp"), F.col("close_time").alias("confirmation_timestamp"), probe.alias("price_level"), side("price_level").alias("reference_level"),
        side("swing_id").alias("swing_id"), side("event_timestamp").alias("reference_swing_timestamp"), side("confirmation_timestamp").alias("reference_swing_confirmation"), F.when(~F.isnan("ratio") & (F.col("ratio") != float("inf")), F.col("ratio")).alias("displacement_ratio"), "idx",
    )
    before = F.lag("direction").over(Window.partitionBy(*KEY).orderBy("idx"))
    hit = hit.withColumn("previous_state", F.coalesce(before, F.lit("undefined"))).withColumn("resulting_state", F.col("direction"))
    goes_on = F.col("previous_state").isin("undefined") | (F.col("previous_state") == F.col("direction"))
    turned = F.lit("mss") if config.choch_policy == "synonym" else F.when(F.col("displacement_ratio") >= config.displacement_factor, "mss").otherwise("choch")
    hit = hit.withColumn("event_type", F.when(goes_on, "bos").otherwise(turned)).withColumn("break_distance_points", F.abs(F.col("price_level") - F.col("reference_level")) / point_of())
    return hit.withColumn("break_id", F.concat_ws(":", F.lit("break"), *KEY, "event_type", stamp("event_timestamp")))


def pending_references(bars: DataFrame, pivots: DataFrame, breaks: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """Per series and side the last confirmed swing, if no bar has broken it."""
    end = bars.groupBy(*KEY).agg(F.max("close_time").alias("_end"))
    seen = pivots.filter(F.col("strength") >= config.min_swing_strength_points).join(end, list(KEY)).filter("confirmation_timestamp <= _end").drop("_end")
    w = Window.partitionBy(*KEY, "direction").orderBy(F.desc("confirmation_timestamp"), F.desc("event_timestamp"))
    return seen.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(breaks.select("swing_id"), "swing_id", "left_anti")
