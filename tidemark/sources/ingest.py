"""Pipelines from sources into the store: one lazy plan per series, run by the write."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import bars as B
from tidemark.operators import coverage
from tidemark.schema import Timeframe, instrument
from tidemark.sources.store import CandleStore, ManifestStore, combined_hash


def _series(store: CandleStore, symbol: str, tf: Timeframe, report: dict | None = None) -> dict:
    parts = {str(r["year"]): r["sha256"] for r in store.digests(symbol, tf).collect()}
    return {"symbol": symbol, "timeframe": tf.name, "partitions": parts, "sha256": combined_hash(parts), "report": report}


def ingest(spark: SparkSession, source, store: CandleStore, manifests: ManifestStore, pairs: list[tuple[str, Timeframe]], start: datetime, end: datetime, version: str, overwrite: bool = False) -> dict:
    """Fetch, normalise and store each pair; a failing pair is recorded and doesn't stop the
    others. Writes the manifest and returns it."""
    done, failed = [], []
    for symbol, tf in pairs:
        try:
            raw = source.fetch(symbol, tf, start, end)
            report = B.normalization_report(raw, tf).first()
            store.write(B.normalize(raw, tf), overwrite)
            done.append(_series(store, symbol, tf, report.asDict() if report else None))
        except Exception as e:  # noqa: BLE001  a pair's own failure, whatever it is
            failed.append({"symbol": symbol, "timeframe": tf.name, "error": f"{type(e).__name__}: {str(e)[:300]}"})
    payload = {"series": done, "failed": failed, "start": start, "end": end}
    manifests.write(version, payload)
    return payload


def ticks_to_stack(ticks: DataFrame, targets: tuple[str, ...] = ("5m", "15m", "1h", "4h", "1d"), side: str = "bid") -> dict[str, DataFrame]:
    """Clean ticks to one-minute bars, and every slower timeframe from those same bars."""
    m1 = Timeframe("1m")
    base = B.ticks_to_bars(B.clean_ticks(ticks), m1, side=side, seq="seq")
    return {"1m": base, **B.timeframe_stack(base, m1, [Timeframe(t) for t in targets])}


def backfill(spark: SparkSession, ticks: DataFrame, store: CandleStore, manifests: ManifestStore, version: str, targets: tuple[str, ...] = ("5m", "15m", "1h", "4h", "1d"), overwrite: bool = False) -> dict:
    """Ticks of any symbols to stored bars of all timeframes, with tick reports."""
    stack = ticks_to_stack(ticks, targets)
    reports = {r["symbol"]: r.asDict() for r in B.tick_report(ticks).collect()}
    done = []
    for name, bars in stack.items():
        for symbol, _, _ in {(s, t, 0) for s, t, _ in store.write(bars, overwrite)}:
            done.append(_series(store, symbol, Timeframe(name), reports.get(symbol)))
    payload = {"series": done, "failed": []}
    manifests.write(version, payload)
    return payload


def production(spark: SparkSession, hourly: DataFrame, daily: DataFrame, store: CandleStore, manifests: ManifestStore, version: str, overwrite: bool = False) -> dict:
    """Native hourly and daily bars as they are, four-hour bars only from whole windows of
    native hours; the manifest has every window's disposition counted."""
    built = coverage.build_h4(hourly)
    counts = {r["symbol"]: r.asDict() for r in coverage.h4_counts(built).collect()}
    for symbol in counts:
        instrument(symbol)
    from pyspark.sql import functions as F

    h4 = built.filter("disposition = 'emitted'").select("timestamp", "symbol", F.lit("4h").alias("timeframe"), "open", "high", "low", "close", "volume")
    done = []
    for name, bars in (("1h", hourly), ("4h", h4), ("1d", daily)):
        for symbol in sorted({k[0] for k in store.write(bars, overwrite)}):
            done.append(_series(store, symbol, Timeframe(name), counts.get(symbol) if name == "4h" else None))
    payload = {"series": done, "failed": []}
    manifests.write(version, payload)
    return payload
