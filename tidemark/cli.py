"""Command line: ingest CSV candles, backfill tick files, verify a manifest."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from tidemark.schema import instrument, timeframe, utc
from tidemark.sources.candles import CsvSource, read_ticks
from tidemark.sources.ingest import backfill, ingest
from tidemark.sources.store import CandleStore, ManifestStore


def moment(text: str) -> datetime:
    """An ISO date or time; without a zone it is UTC."""
    t = datetime.fromisoformat(text)
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--store", default="store")
    p.add_argument("--manifests", default="manifests")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "backfill"):
        c = sub.add_parser(name)
        c.add_argument("--source", required=True)
        c.add_argument("--version", required=True)
        c.add_argument("--overwrite", action="store_true")
        if name == "ingest":
            c.add_argument("--symbols", nargs="+", default=["EURUSD", "XAUUSD"])
            c.add_argument("--timeframes", nargs="+", default=["5m"])
            c.add_argument("--start", type=moment, required=True)
            c.add_argument("--end", type=moment, required=True)
    sub.add_parser("verify").add_argument("--version", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 1 if a pair failed or a partition is not as recorded."""
    a = parser().parse_args(argv)
    spark = utc(spark or SparkSession.builder.appName("tidemark").getOrCreate())
    store, manifests = CandleStore(spark, a.store), ManifestStore(a.manifests)
    if a.command == "ingest":
        pairs = [(instrument(s)[0], timeframe(t)) for s in a.symbols for t in a.timeframes]
        got = ingest(spark, CsvSource(spark, a.source), store, manifests, pairs, a.start, a.end, a.version, a.overwrite)
        for s in got["series"]:
            print(f"{s['symbol']} {s['timeframe']} {s['sha256'][:12]} {s['report']}")
        for s in got["failed"]:
            print(f"FAILED {s['symbol']} {s['timeframe']}: {s['error']}")
        return int(bool(got["failed"]))
    if a.command == "backfill":
        got = backfill(spark, read_ticks(spark, a.source), store, manifests, a.version, overwrite=a.overwrite)
        print(f"{len(got['series'])} series")
        return 0
    faults = manifests.verify(a.version, store)
    print("\n".join(faults) or "ok")
    return int(bool(faults))


if __name__ == "__main__":
    raise SystemExit(main())
