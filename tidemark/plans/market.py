"""The detectors over one frame of bars, each computed once and shared."""

from __future__ import annotations

from dataclasses import asdict
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import blocks, gaps, liquidity, ranges, swings
from tidemark.operators import calendar as cal
from tidemark.schema import SESSIONS, Timeframe, prepared, utc
from tidemark.sources.shared import kept


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks: a symbol per event type, a price per value."""
    ev = utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("price"), F.col("event_id").alias("seq"))


def event_bars(spark: SparkSession, sf_dir: str, tf: Timeframe) -> DataFrame:
    return B.ticks_to_bars(event_ticks(spark, sf_dir), tf, price="price", seq="seq")


class Market:
    """Lazily built, shared views over bars of any number of series.

    What several detectors read (bars, swings, gaps, blocks, breaks) is written once to the
    shared folder and read from there, which keeps the plans of what follows short."""

    def __init__(
        self, raw: DataFrame, tf: Timeframe, swing_config=swings.SwingConfig(), structure_config=swings.StructureConfig(), fvg_config=gaps.FvgConfig(), block_config=blocks.OrderBlockConfig(), liquidity_config=liquidity.LiquidityConfig(), sessions=SESSIONS, require_structure: bool = True, strict_propagation: bool = False,
        ifvg_config=gaps.IfvgConfig(), bpr_config=gaps.BprConfig(), rdrb_config=gaps.RdrbConfig(), breaker_config=blocks.BreakerConfig(), unicorn_config=blocks.UnicornConfig(), cisd_config=blocks.CisdConfig(), range_config=ranges.RangeConfig(),
    ):
        self.raw, self.tf, self.spark = raw, tf, raw.sparkSession
        self.swing_config, self.structure_config, self.fvg_config = swing_config, structure_config, fvg_config
        self.block_config, self.liquidity_config, self.session_defs = block_config, liquidity_config, sessions
        self.require_structure, self.strict_propagation = require_structure, strict_propagation
        self.ifvg_config, self.bpr_config, self.rdrb_config = ifvg_config, bpr_config, rdrb_config
        self.breaker_config, self.unicorn_config, self.cisd_config, self.range_config = breaker_config, unicorn_config, cisd_config, range_config

    def _kept(self, df: DataFrame) -> DataFrame:
        return kept(df, "market")

    @cached_property
    def bars(self) -> DataFrame:
        return self._kept(prepared(self._kept(self.raw), self.tf))

    @cached_property
    def swings(self) -> DataFrame:
        return self._kept(swings.swings(self.bars, self.swing_config))

    @cached_property
    def labels(self) -> DataFrame:
        return swings.swing_labels(self.swings, self.structure_config)

    @cached_property
    def breaks(self) -> DataFrame:
        return self._kept(swings.structure_breaks(self.bars, self.swings, self.structure_config))

    @cached_property
    def default_breaks(self) -> DataFrame:
        """Breaks over default swings, which breakers and dealing ranges use unless
        strict_propagation hands them the configured ones."""
        if self.strict_propagation or self.swing_config == swings.SwingConfig():
            return self.breaks
        return self._kept(swings.structure_breaks(self.bars, swings.swings(self.bars), self.structure_config))

    @cached_property
    def fvg(self) -> DataFrame:
        return self._kept(gaps.fvg_zones(self.bars, self.fvg_config))

    @cached_property
    def fvg_fills(self) -> DataFrame:
        return gaps.fvg_fills(self.fvg, self.bars, self.fvg_config)

    @cached_property
    def ifvg(self) -> DataFrame:
        return self._kept(gaps.ifvg(self.fvg, self.bars, **asdict(self.ifvg_config)))

    @cached_property
    def bpr(self) -> DataFrame:
        return self._kept(gaps.bpr(self.fvg, self.tf, **asdict(self.bpr_config)))

    @cached_property
    def rdrb(self) -> DataFrame:
        return self._kept(gaps.rdrb(self.bars, self.rdrb_config))

    @cached_property
    def blocks(self) -> DataFrame:
        return self._kept(blocks.order_blocks(self.bars, self.fvg, self.block_config))

    @cached_property
    def failures(self) -> DataFrame:
        return self._kept(blocks.failures(self.blocks, self.bars, wick=self.breaker_config.wick))

    @cached_property
    def breakers(self) -> DataFrame:
        return self._kept(blocks.breakers(self.blocks, self.failures, self.default_breaks, self.bars, self.require_structure, self.breaker_config.max_bars))

    @cached_property
    def unicorns(self) -> DataFrame:
        return self._kept(blocks.unicorns(self.breakers, self.fvg, self.tf, **asdict(self.unicorn_config)))

    @cached_property
    def cisd(self) -> DataFrame:
        return self._kept(blocks.cisd(self.bars, **asdict(self.cisd_config)))

    @cached_property
    def ranges(self) -> DataFrame:
        return self._kept(ranges.dealing_ranges(self.default_breaks, self.swings))

    @cached_property
    def observations(self) -> DataFrame:
        return ranges.observations(self.bars, self.ranges, **asdict(self.range_config))

    @cached_property
    def windows(self) -> DataFrame:
        return self._kept(cal.windows(self.spark, cal.span_of(self.bars), self.session_defs))

    @cached_property
    def day_windows(self) -> DataFrame:
        return self._kept(cal.windows(self.spark, cal.span_of(self.bars), cal.TRADING_DAY))

    @cached_property
    def sessions(self) -> DataFrame:
        return cal.sessions(self.bars, self.windows, self.session_defs)

    @cached_property
    def days(self) -> DataFrame:
        return cal.trading_days(self.bars, self.day_windows)

    @cached_property
    def weeks(self) -> DataFrame:
        return cal.trading_weeks(self.bars, self.day_windows)

    @cached_property
    def daily_opens(self) -> DataFrame:
        return cal.daily_opens(self.bars)

    @cached_property
    def levels(self) -> DataFrame:
        lq = liquidity
        return self._kept(lq.all_levels(lq.swing_levels(self.swings), lq.equal_levels(self.swings, self.liquidity_config), lq.session_levels(self.sessions), lq.period_levels(self.days, self.weeks)))

    @cached_property
    def sweeps(self) -> DataFrame:
        return self._kept(liquidity.sweeps(self.levels, self.bars, self.liquidity_config))
