"""Bars and gaps from streams.

The batch operators take the last supplied of duplicates; a stream in append mode cannot
know what comes later, so late rows beyond the watermark are dropped and duplicates
within it are kept once. On data without either, the streams agree with the batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import Timeframe


def stream_bars(ticks: DataFrame, tf: Timeframe, price: str = "price", seq: str = "seq", delay: str = "10 minutes") -> DataFrame:
    """Closed bars of a stream of ticks (symbol, timestamp, price, seq), in append mode."""
    order = F.struct("timestamp", seq)
    rows = ticks.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["symbol", seq])
    g = rows.groupBy("symbol", F.window("timestamp", f"{tf.minutes} minutes").alias("w"))
    out = g.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.select(F.col("w.start").alias("timestamp"), "symbol", F.lit(tf.name).alias("timeframe"), "open", "high", "low", "close", "volume", F.col("w.end").alias("close_time"))


def stream_running_period(ticks: DataFrame, price: str = "price", delay: str = "10 minutes", period: str = "1 day") -> DataFrame:
    """Running extremes of the period in hand (update mode): never levels, only state."""
    g = ticks.withWatermark("timestamp", delay).groupBy("symbol", F.window("timestamp", period).alias("w"))
    return g.agg(F.max(price).alias("high_price"), F.min(price).alias("low_price"), F.max("timestamp").alias("observed_end")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "high_price", "low_price", "observed_end")
