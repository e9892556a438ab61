"""Bars from ticks, bars from bars, cleaning and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import KEY, Timeframe, floor_to, series_window

PRICES = ("open", "high", "low", "close")


def ticks_to_bars(ticks: DataFrame, tf: Timeframe, price: str | None = None, side: str = "bid", seq: str | None = None) -> DataFrame:
    """Left-closed bars labelled by their open; volume counts ticks; no bar for an empty
    period. price names a column, else side is bid, ask or mid. Ticks of one instant are
    taken in order of seq."""
    value = F.col(price) if price else {"bid": F.col("bid"), "ask": F.col("ask"), "mid": (F.col("bid") + F.col("ask")) / 2}[side]
    order = F.struct("timestamp", *([seq] if seq else []))
    rows = ticks.withColumn("_v", value.cast("double")).withColumn("_o", order).withColumn("_t", floor_to(F.col("timestamp"), tf.minutes))
    out = rows.groupBy("symbol", "_t").agg(F.min_by("_v", "_o").alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", "_o").alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select(F.col("_t").alias("timestamp"), "symbol", F.lit(tf.name).alias("timeframe"), *PRICES, "volume")


def resample(bars: DataFrame, source: Timeframe, target: Timeframe, drop_boundary: bool = True) -> DataFrame:
    """Bars of a slower timeframe with close_time. A bar is dropped only if its period is
    not inside the series' first open and last close; gaps inside a period keep it."""
    if not source.divides(target):
        raise ValueError(f"{target.name} cannot be built from {source.name}")
    step = F.expr(f"_t + INTERVAL '{target.minutes}' MINUTE")
    rows = bars.withColumn("_t", floor_to(F.col("timestamp"), target.minutes))
    out = rows.groupBy("symbol", "_t").agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"))
    if drop_boundary:
        ends = bars.groupBy("symbol").agg(F.min("timestamp").alias("_first"), F.expr(f"max(timestamp) + INTERVAL '{source.minutes}' MINUTE").alias("_last"))
        out = out.join(ends, out["symbol"].eqNullSafe(ends["symbol"])).drop(ends["symbol"]).filter((F.col("_t") >= F.col("_first")) & (step <= F.col("_last")))
    return out.select(F.col("_t").alias("timestamp"), "symbol", F.lit(target.name).alias("timeframe"), *PRICES, "volume", step.alias("close_time"))


def timeframe_stack(bars: DataFrame, source: Timeframe, targets: list[Timeframe]) -> dict[str, DataFrame]:
    """Every target from the same base bars."""
    return {t.name: resample(bars, source, t) for t in targets}


def valid_ohlc() -> Column:
    """A timestamp, no missing number, high and low at the extremes, volume not negative."""
    some = F.col("timestamp").isNotNull()
    for c in (*PRICES, "volume"):
        some = some & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return some & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low")) & (F.col("volume") >= 0)


def coerce(raw: DataFrame, symbol: str | None, tf: Timeframe) -> DataFrame:
    """Types as bars have them; what cannot be read becomes null. The caller's symbol and
    timeframe replace the data's."""
    nums = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in (*PRICES, "volume")}
    out = raw.withColumns({"timestamp": F.expr("try_cast(timestamp AS TIMESTAMP)"), **nums, "timeframe": F.lit(tf.name)})
    return out.withColumn("symbol", F.lit(symbol)) if symbol else out


def normalize(raw: DataFrame, tf: Timeframe, seq: str = "seq", symbol: str | None = None) -> DataFrame:
    """Canonical bars from raw ones: floor to the grid, keep the last supplied of each
    timestamp (by seq), and only then drop invalid rows, those whose timestamp can't be read too
    (normalization_report counts each of them)."""
    if seq not in raw.columns:
        raise ValueError(f"rows have no order of their own: column {seq!r} is needed")
    rows = coerce(raw, symbol, tf).withColumn("timestamp", floor_to(F.col("timestamp"), tf.minutes))
    last = Window.partitionBy(*KEY, "timestamp").orderBy(F.col(seq).desc())
    rows = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return rows.filter(valid_ohlc()).select("timestamp", *KEY, *PRICES, "volume")


def normalization_report(raw: DataFrame, tf: Timeframe, seq: str = "seq", symbol: str | None = None) -> DataFrame:
    """One row per series: rows in and out, floored, out of order, duplicates, invalid."""
    rows = coerce(raw, symbol, tf).withColumn("_floor", floor_to(F.col("timestamp"), tf.minutes))
    by_seq = Window.partitionBy(*KEY).orderBy(seq)
    last = Window.partitionBy(*KEY, "_floor").orderBy(F.col(seq).desc())
    rows = rows.withColumn("_back", F.coalesce(F.col("_floor") < F.lag("_floor").over(by_seq), F.lit(False))).withColumn("_n", F.row_number().over(last))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("rows_in"), F.count_if((F.col("_n") == 1) & valid_ohlc()).alias("rows_out"), F.count_if(F.col("_floor") != F.col("timestamp")).alias("floored"),
        F.count_if("_back").alias("out_of_order"), F.count_if((F.col("_n") > 1) & F.col("_floor").isNotNull()).alias("duplicates"), F.count_if(F.col("_floor").isNull() | (F.col("_n") == 1) & ~valid_ohlc()).alias("invalid"),
    )


def gaps(bars: DataFrame, tf: Timeframe, max_gap_bars: int = 3) -> DataFrame:
    """Missing stretches between neighbouring bars: start, end, bar_count, significant."""
    step = tf.minutes * 60
    before = F.lag("timestamp").over(series_window())
    delta = F.unix_seconds("timestamp") - F.unix_seconds("_before")
    rows = bars.withColumn("_before", before).withColumn("_d", delta).filter(F.col("_d") > step)
    count = (F.floor(F.col("_d") / step) - 1).cast("long")
    return rows.select(*KEY, F.expr(f"_before + INTERVAL '{tf.minutes}' MINUTE").alias("start"), F.col("timestamp").alias("end"), count.alias("bar_count"), (count > max_gap_bars).alias("significant"))


def tick_faults(ticks: DataFrame) -> DataFrame:
    """Ticks with a boolean column per fault; a tick may have several."""
    quote = lambda c: F.col(c).isNull() | F.isnan(c)
    missing = quote("bid") | quote("ask")
    negative = (F.coalesce(F.col("bid_volume"), F.lit(0.0)) < 0) | (F.coalesce(F.col("ask_volume"), F.lit(0.0)) < 0)
    return ticks.withColumns({"is_missing": missing, "is_nonpositive": ~missing & ((F.col("bid") <= 0) | (F.col("ask") <= 0)), "is_crossed": ~missing & (F.col("bid") > F.col("ask")), "is_negative_volume": negative})


def clean_ticks(ticks: DataFrame, seq: str = "seq") -> DataFrame:
    """Ticks without a fault; of identical (timestamp, bid, ask) the first supplied."""
    good = tick_faults(ticks).filter("NOT (is_missing OR is_nonpositive OR is_crossed OR is_negative_volume)").select(*ticks.columns)
    first = Window.partitionBy("symbol", "timestamp", "bid", "ask").orderBy(seq)
    return good.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def tick_report(ticks: DataFrame, seq: str = "seq") -> DataFrame:
    """Per symbol: counts by fault, duplicates, widest spread. Reports of parts merge by
    sums and maxima."""
    f = tick_faults(ticks)
    first = Window.partitionBy("symbol", "timestamp", "bid", "ask").orderBy(seq)
    bad = F.col("is_missing") | F.col("is_nonpositive") | F.col("is_crossed") | F.col("is_negative_volume")
    f = f.withColumn("_bad", bad).withColumn("_n", F.row_number().over(first.partitionBy("symbol", "timestamp", "bid", "ask", "_bad")))
    return f.groupBy("symbol").agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(c[3:]) for c in ("is_missing", "is_nonpositive", "is_crossed", "is_negative_volume")],
        F.count_if(~F.col("_bad") & (F.col("_n") > 1)).alias("duplicates"), F.count_if(~F.col("_bad") & (F.col("_n") == 1)).alias("kept"), F.max(F.when(~F.col("_bad"), F.col("ask") - F.col("bid"))).alias("max_spread"),
    )


def merge_tick_reports(reports: DataFrame) -> DataFrame:
    sums = [c for c in reports.columns if c not in ("symbol", "max_spread")]
    return reports.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in sums], F.max("max_spread").alias("max_spread"))
