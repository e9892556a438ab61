"""Candle and tick sources: CSV trees and binary hour or month files.

A source has `name`, `supports(symbol, tf)` and `fetch(symbol, tf, start, end)`, which
returns bars that open in [start, end)."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import CANDLE, INSTRUMENTS, Timeframe, instrument, timeframe
from tidemark.sources.shared import importable

# The layouts of the binary files. Ticks: milliseconds, ask and bid in
# points, ask and bid volume. Candles: seconds, open, close, low, high in points, volume.
TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
BAR = np.dtype([("sec", ">i4"), ("open", ">i4"), ("close", ">i4"), ("low", ">i4"), ("high", ">i4"), ("volume", ">f4")])
TICK_SCHEMA = "symbol string, timestamp timestamp, bid double, ask double, bid_volume double, ask_volume double, seq long, trailing_bytes long"


@runtime_checkable
class Source(Protocol):
    name: str

    def supports(self, symbol: str, tf: Timeframe) -> bool: ...

    def fetch(self, symbol: str, tf: Timeframe, start: datetime, end: datetime) -> DataFrame: ...


def utc_instant(moment: datetime) -> datetime:
    """An aware instant; naive ones are refused, since they name no instant."""
    if moment.tzinfo is None:
        raise ValueError(f"{moment!r} has no time zone")
    return moment.astimezone(UTC)


class CsvSource:
    """<root>/<SYMBOL>/<timeframe>.csv with timestamp, open, high, low, close, volume."""

    name = "csv"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, symbol: str, tf: Timeframe) -> str:
        return f"{self.root}/{symbol}/{tf.name}.csv"

    def supports(self, symbol: str, tf: Timeframe) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(symbol, tf))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def fetch(self, symbol: str, tf: Timeframe, start: datetime, end: datetime) -> DataFrame:
        """Raw bars with seq, the order in the file (by file offset of the partition)."""
        symbol = instrument(symbol)[0]
        if not self.supports(symbol, tf):
            raise FileNotFoundError(self.path(symbol, tf))
        raw = self.spark.read.option("header", True).csv(self.path(symbol, tf))
        lost = {"timestamp", "open", "high", "low", "close", "volume"} - set(raw.columns)
        if lost:
            raise ValueError(f"{self.path(symbol, tf)} has no {sorted(lost)}")
        a, z = utc_instant(start), utc_instant(end)
        rows = raw.withColumn("seq", F.monotonically_increasing_id()).withColumn("timestamp", F.expr("try_cast(timestamp AS timestamp)")).withColumn("symbol", F.lit(symbol)).withColumn("timeframe", F.lit(tf.name))
        rows = rows.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("open", "high", "low", "close", "volume")})
        return rows.filter((F.col("timestamp") >= F.lit(a)) & (F.col("timestamp") < F.lit(z))).select("timestamp", "symbol", "timeframe", "open", "high", "low", "close", "volume", "seq")


def tick_path(symbol: str, hour: datetime) -> str:
    """<SYMBOL>/<year>/<month from 00>/<day>/<hour>h_ticks.bi5"""
    h = utc_instant(hour)
    return f"{symbol}/{h.year:04d}/{h.month - 1:02d}/{h.day:02d}/{h.hour:02d}h_ticks.bi5"


def hours_between(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """Every UTC hour that meets [start, end)."""
    one = spark.range(1).select(F.explode(F.expr(f"sequence(date_trunc('HOUR', timestamp '{utc_instant(start):%Y-%m-%d %H:%M:%S}'), timestamp '{utc_instant(end):%Y-%m-%d %H:%M:%S}' - INTERVAL '1' MICROSECOND, INTERVAL '1' HOUR)")).alias("hour"))
    return one


def months_between(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date '{utc_instant(start):%Y-%m-%d}', 'MM'), date(timestamp '{utc_instant(end):%Y-%m-%d %H:%M:%S}' - INTERVAL '1' MICROSECOND), INTERVAL '1' MONTH)")).alias("month"))


def native_candle_path(symbol: str, tf: Timeframe, month: datetime) -> str:
    if tf.name not in ("1h", "1d"):
        raise ValueError(f"native candles exist for 1h and 1d only, not {tf.name}")
    return f"{symbol}/{month.year:04d}/{month.month - 1:02d}/BID_candles_{'hour' if tf.name == '1h' else 'day'}_1.bi5"


def unpacked(payload: bytes, what: str) -> bytes:
    if not payload:
        return b""
    try:
        return lzma.decompress(payload)
    except lzma.LZMAError as e:
        raise ValueError(f"{what} is corrupt: {e}") from e


def decode_ticks(payload: bytes, symbol: str, hour: datetime) -> pd.DataFrame:
    """An hour's ticks. No payload is no tick; bytes past the last whole record are counted."""
    data = unpacked(payload, f"{symbol} {hour}")
    n = len(data) // TICK.itemsize
    r = np.frombuffer(data[: n * TICK.itemsize], TICK)
    scale = 10.0 ** INSTRUMENTS[symbol][0]
    base = np.datetime64(utc_instant(hour).replace(tzinfo=None), "us")
    return pd.DataFrame(
        {
            "symbol": symbol, "timestamp": base + r["ms"].astype("i8") * np.timedelta64(1000, "us"), "bid": r["bid"] / scale, "ask": r["ask"] / scale, "bid_volume": r["bid_volume"].astype(float), "ask_volume": r["ask_volume"].astype(float),
            "seq": np.arange(n), "trailing_bytes": len(data) - n * TICK.itemsize,
        }
    )


def decode_candles(payload: bytes, symbol: str, tf: Timeframe, month: datetime) -> pd.DataFrame:
    """A month's native candles, with padding (no volume and no movement) marked."""
    data = unpacked(payload, f"{symbol} {month}")
    if len(data) % BAR.itemsize:
        raise ValueError(f"{symbol} {month}: {len(data)} bytes are no whole number of candles")
    r = np.frombuffer(data, BAR)
    point = INSTRUMENTS[symbol][1]
    base = np.datetime64(utc_instant(month).replace(tzinfo=None), "us")
    out = pd.DataFrame({"timestamp": base + r["sec"].astype("i8") * np.timedelta64(1_000_000, "us"), "symbol": symbol, "timeframe": tf.name, **{c: r[c] * point for c in ("open", "high", "low", "close")}, "volume": r["volume"].astype(float)})
    flat = (out["open"] == out["high"]) & (out["high"] == out["low"]) & (out["low"] == out["close"])
    out["is_padding"] = (out["volume"] == 0) & flat
    return out


def _path_time(path: str, hourly: bool) -> tuple[str, datetime]:
    p = path.rstrip("/").split("/")
    if hourly:
        return p[-5], datetime(int(p[-4]), int(p[-3]) + 1, int(p[-2]), int(p[-1][:2]), tzinfo=UTC)
    return p[-4], datetime(int(p[-3]), int(p[-2]) + 1, 1, tzinfo=UTC)


def read_ticks(spark: SparkSession, root: str) -> DataFrame:
    """All hour files under root, each decoded by one task; a corrupt file raises."""
    importable(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*h_ticks.bi5").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                symbol, hour = _path_time(path, True)
                yield decode_ticks(bytes(content), symbol, hour)

    return files.mapInPandas(run, TICK_SCHEMA)


def read_candles(spark: SparkSession, root: str, tf: str | Timeframe) -> DataFrame:
    """All native month files of a timeframe under root, without padding."""
    tf = timeframe(tf)
    name = "BID_candles_hour_1.bi5" if tf.name == "1h" else "BID_candles_day_1.bi5"
    importable(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                symbol, month = _path_time(path, False)
                yield decode_candles(bytes(content), symbol, tf, month)

    schema = T.StructType([*CANDLE.fields, T.StructField("is_padding", T.BooleanType())])
    return files.mapInPandas(run, schema).filter("NOT is_padding").drop("is_padding")


def encode_ticks(rows: list[tuple[int, int, int, float, float]]) -> bytes:
    """The bytes of an hour file; the inverse of decode_ticks, for fixtures."""
    return lzma.compress(b"".join(struct.pack(">IIIff", *r) for r in rows)) if rows else b""


def make_source(spark: SparkSession, settings: dict) -> Source:
    """The configured source; anything unknown falls back to CSV with a warning."""
    kind = settings.get("provider", "csv")
    if kind != "csv":
        import warnings

        warnings.warn(f"source {kind!r} needs a network and is not available; reading CSV", stacklevel=2)
    return CsvSource(spark, settings.get("root", "."))
