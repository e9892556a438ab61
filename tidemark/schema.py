"""Fixed dimensions and column layouts: timeframes, instruments, sessions, bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Minutes of each timeframe, precision and pip of each instrument.
TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}
INSTRUMENTS = {"EURUSD": (5, 1e-5, 1e-4), "XAUUSD": (3, 1e-3, 1e-2)}
# Session name, time zone, local start and end.
SESSIONS = (
    ("asian", "Asia/Tokyo", "09:00", "18:00"),
    ("london", "Europe/London", "08:00", "16:30"),
    ("new_york", "America/New_York", "08:00", "17:00"),
    ("london_kill_zone", "America/New_York", "02:00", "05:00"),
    ("new_york_kill_zone", "America/New_York", "07:00", "10:00"),
)
NEW_YORK = "America/New_York"
BULL, BEAR, NEUTRAL = "bullish", "bearish", "neutral"
KEY = ("symbol", "timeframe")

CANDLE = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), T.StructField("symbol", T.StringType()), T.StructField("timeframe", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)


@dataclass(frozen=True)
class Timeframe:
    name: str

    def __post_init__(self) -> None:
        if self.name not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe {self.name!r}; one of {sorted(TIMEFRAMES)}")

    @property
    def minutes(self) -> int:
        return TIMEFRAMES[self.name]

    def divides(self, target: Timeframe) -> bool:
        """Whether bars of this timeframe can be combined into the target's."""
        return self.minutes < target.minutes and target.minutes % self.minutes == 0


def timeframe(name: str | Timeframe) -> Timeframe:
    """Any spelling of a timeframe; raises ValueError with the valid ones."""
    return name if isinstance(name, Timeframe) else Timeframe(name.strip().lower())


def instrument(name: str) -> tuple[str, int, float, float]:
    key = name.strip().upper()
    if key not in INSTRUMENTS:
        raise ValueError(f"unknown symbol {name!r}; one of {sorted(INSTRUMENTS)}")
    return (key, *INSTRUMENTS[key])


def utc(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def point_of(symbol: str = "symbol", default: float = 0.01):
    """The point value of a row's instrument."""
    out = F.lit(default)
    for name, (_, point, _) in INSTRUMENTS.items():
        out = F.when(F.col(symbol) == name, F.lit(point)).otherwise(out)
    return out


def series_window():
    return Window.partitionBy(*KEY).orderBy("timestamp")


def with_close_time(bars: DataFrame, tf: Timeframe) -> DataFrame:
    return bars.withColumn("close_time", F.expr(f"timestamp + INTERVAL '{tf.minutes}' MINUTE"))


#: Bars of a block, as a power of two: what one task sorts at a time, however long the series.
BLOCK_LOG2 = 14


def prepared(bars: DataFrame, tf: Timeframe) -> DataFrame:
    """Bars with close_time and idx, their place in the series from 0.

    Places are counted within stretches of time and added up over the stretches, so no task
    sorts a whole series. Reads bars twice."""
    rows = with_close_time(bars, tf).withColumn("_cell", F.floor(F.unix_seconds("timestamp") / (tf.minutes * 60 << BLOCK_LOG2)))
    counts = rows.groupBy(*KEY, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("_cell").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_cell").eqNullSafe(F.col("_c"))
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*KEY, "_cell").orderBy("timestamp")) - 1
    return rows.join(counts, same).withColumn("idx", (F.col("_before") + place).cast("long")).drop("_cell", "_c", "_before", *[f"_{c}" for c in KEY])


def framed(bars: DataFrame, before: int, after: int) -> DataFrame:
    """Bars in blocks (_block), each with copies of the `before` bars ahead of it and the
    `after` bars behind it. Frames of that reach are whole over block_window for rows that are
    _own; keep only those afterwards."""
    first, last = F.shiftright(F.greatest(F.col("idx") - after, F.lit(0)), BLOCK_LOG2), F.shiftright(F.col("idx") + before, BLOCK_LOG2)
    return bars.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == F.shiftright("idx", BLOCK_LOG2))


def block_window():
    return Window.partitionBy(*KEY, "_block").orderBy("idx")


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("_own").drop("_own", "_block")


def floor_to(column, minutes: int):
    """A timestamp floored to the grid of so many minutes since the epoch."""
    step = minutes * 60_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(column) / F.lit(step)).cast("long") * step)
