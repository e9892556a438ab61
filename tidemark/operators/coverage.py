"""Which bars a market was open for, and what is missing from slower bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import PRICES
from tidemark.schema import Timeframe, floor_to


def grid(bars: DataFrame, tf: Timeframe) -> DataFrame:
    """Per symbol every instant from the first to the last bar, and whether it has one.
    The instants of a series are generated in stretches, by many tasks."""
    step = f"INTERVAL '{tf.minutes}' MINUTE"
    ends = bars.groupBy("symbol").agg(F.min("timestamp").alias("_a"), F.max("timestamp").alias("_z"))
    far = ends.withColumn("_s", F.explode(F.expr(f"sequence(_a, _z, INTERVAL '{tf.minutes * 4096}' MINUTE)"))).repartition("symbol", "_s")
    every = far.withColumn("timestamp", F.explode(F.expr(f"sequence(_s, least(_z, _s + INTERVAL '{tf.minutes * 4095}' MINUTE), {step})"))).select("symbol", "timestamp")
    seen = bars.select("symbol", "timestamp", F.lit(True).alias("seen")).distinct()
    return every.join(seen, ["symbol", "timestamp"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def _slot(df: DataFrame) -> DataFrame:
    return df.withColumn("weekday", F.weekday("timestamp")).withColumn("minute", F.hour("timestamp") * 60 + F.minute("timestamp"))


def session_profile(bars: DataFrame, tf: Timeframe, min_occurrences: int = 2) -> DataFrame:
    """symbol, weekday, minute of slots that recur and never have a bar: the market is shut."""
    slots = _slot(grid(bars, tf)).groupBy("symbol", "weekday", "minute").agg(F.count_if("seen").alias("_seen"), F.count(F.lit(1)).alias("occurrences"))
    return slots.filter((F.col("_seen") == 0) & (F.col("occurrences") >= min_occurrences)).drop("_seen")


def weekday_occurrences(bars: DataFrame, tf: Timeframe) -> DataFrame:
    return _slot(grid(bars, tf)).groupBy("symbol", "weekday").agg(F.countDistinct(F.to_date("timestamp")).alias("days"))


def coverage(bars: DataFrame, source: Timeframe, target: Timeframe, profile: DataFrame | None = None) -> DataFrame:
    """Per target bar with any source bar: what is expected, there, shut, undetermined, the
    longest missing run, the cause and the quality."""
    shut = (profile if profile is not None else session_profile(bars, source)).select("symbol", "weekday", "minute", F.lit(True).alias("shut"))
    g = _slot(grid(bars, source)).join(shut, ["symbol", "weekday", "minute"], "left").withColumn("shut", F.coalesce("shut", F.lit(False)))
    ends = bars.groupBy("symbol").agg(F.min("timestamp").alias("_a"), F.expr(f"max(timestamp) + INTERVAL '{source.minutes}' MINUTE").alias("_z"))
    g = g.withColumn("bar", floor_to(F.col("timestamp"), target.minutes))
    w = Window.partitionBy("symbol", "bar").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_island", F.count_if("seen").over(w))
    run = F.count_if(~F.col("seen")).over(Window.partitionBy("symbol", "bar", "_island"))
    out = g.withColumn("_run", run).groupBy("symbol", "bar").agg(
        F.count_if("seen").alias("actual"), F.count_if(~F.col("seen") & F.col("shut")).alias("market_closed"), F.count_if(~F.col("seen") & ~F.col("shut")).alias("undetermined"), F.max(F.when(~F.col("seen"), F.col("_run")).otherwise(0)).alias("longest_missing_run"),
    )
    out = out.filter("actual > 0").join(ends, "symbol")
    boundary = (F.col("bar") < F.col("_a")) | (F.expr(f"bar + INTERVAL '{target.minutes}' MINUTE") > F.col("_z"))
    expected = target.minutes // source.minutes
    out = out.withColumn("expected", F.lit(expected)).withColumn("boundary_incomplete", boundary)
    missing = F.col("market_closed") + F.col("undetermined")
    cause = F.when(boundary, "boundary").when((missing == 0) & (F.col("actual") == expected), "none").when(F.col("undetermined") == 0, "market_closed").otherwise("undetermined")
    out = out.withColumn("cause", cause)
    quality = F.when(F.col("cause") == "boundary", "boundary_incomplete").when(F.col("cause") == "none", "complete").when(F.col("cause") == "market_closed", "market_gap").otherwise("degraded_unknown")
    return out.select("symbol", F.col("bar").alias("timestamp"), "expected", "actual", "market_closed", "undetermined", "longest_missing_run", "boundary_incomplete", "cause", quality.alias("quality"), (F.col("actual") / F.col("expected")).alias("coverage_ratio"), (~F.col("boundary_incomplete")).alias("production_eligible"))


# The buckets a summary has even when they are empty.
QUALITIES = ("complete", "market_gap", "degraded_unknown", "boundary_incomplete")
CAUSES = ("none", "market_closed", "undetermined", "boundary")


def coverage_summary(report: DataFrame) -> DataFrame:
    """Per symbol the bars of each quality and each cause, and how many are refused."""
    return report.groupBy("symbol").agg(*[F.count_if(F.col("quality") == q).alias(f"quality_{q}") for q in QUALITIES], *[F.count_if(F.col("cause") == c).alias(f"cause_{c}") for c in CAUSES], F.count_if(~F.col("production_eligible")).alias("rejected"))


def build_h4(hourly: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Four-hour windows of native hourly bars with a disposition; only windows with all
    four hours are emitted (disposition emitted carries the bar)."""
    h1, h4 = Timeframe("1h"), Timeframe("4h")
    shut = (profile if profile is not None else session_profile(hourly, h1)).select("symbol", "weekday", "minute", F.lit(True).alias("shut"))
    work = hourly.withColumn("window", floor_to(F.col("timestamp"), h4.minutes))
    ends = hourly.groupBy("symbol").agg(F.min("timestamp").alias("_a"), F.expr("max(timestamp) + INTERVAL '60' MINUTE").alias("_z"))
    got = work.groupBy("symbol", "window").agg(F.collect_set("timestamp").alias("present"), F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.timestamp_micros(F.unix_micros("window") + i * F.lit(3_600_000_000)))
    got = got.withColumn("missing", F.array_except(hours, "present"))
    gone = got.select("symbol", "window", F.explode("missing").alias("timestamp"))
    closed = _slot(gone).join(shut, ["symbol", "weekday", "minute"]).groupBy("symbol", "window").agg(F.count(F.lit(1)).alias("closed_hours"))
    rows = got.join(closed, ["symbol", "window"], "left").join(ends, "symbol").withColumn("closed_hours", F.coalesce("closed_hours", F.lit(0)))
    outside = (F.col("window") < F.col("_a")) | (F.expr("window + INTERVAL '240' MINUTE") > F.col("_z"))
    n = F.size("missing")
    disposition = F.when(outside, "withheld_boundary").when(n == 0, "emitted").when(F.col("closed_hours") == n, "withheld_market_closed").otherwise("withheld_undetermined")
    rows = rows.withColumn("disposition", disposition)
    keep = lambda c: F.when(F.col("disposition") == "emitted", F.col(c)).alias(c)
    return rows.select("symbol", F.col("window").alias("timestamp"), (4 - n).alias("present_hours"), n.alias("missing_hours"), "closed_hours", "disposition", *[keep(c) for c in (*PRICES, "volume")])


# The dispositions of a window.
DISPOSITIONS = ("emitted", "withheld_boundary", "withheld_market_closed", "withheld_undetermined")


def h4_counts(built: DataFrame) -> DataFrame:
    return built.groupBy("symbol").agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS], F.count(F.lit(1)).alias("windows"))
