"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.operators import swings  # noqa: E402
from tidemark.plans.market import Market, event_bars  # noqa: E402
from tidemark.plans.state import feature_vectors  # noqa: E402
from tidemark.schema import Timeframe  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tf = Timeframe("15m")
    fresh = lambda: Market(event_bars(spark, SF_DIR, tf), tf)

    def detect(m: Market) -> int:
        """Every detector, as its results are read."""
        parts = (m.swings, m.labels, m.breaks, m.fvg, m.fvg_fills, m.ifvg, m.bpr, m.rdrb, m.blocks, m.failures, m.breakers, m.unicorns, m.cisd, m.ranges, m.observations, m.sessions, m.days, m.weeks, m.daily_opens, m.levels, m.sweeps)
        return sum(p.count() for p in parts)

    queries = {
        "bars_15m": lambda: event_bars(spark, SF_DIR, tf).count(), "swings": lambda: swings.swings(fresh().bars).count(), "structure_breaks": lambda: fresh().breaks.count(), "fvg_fills": lambda: fresh().fvg_fills.count(), "ifvg": lambda: fresh().ifvg.count(),
        "unicorns": lambda: fresh().unicorns.count(), "liquidity_sweeps": lambda: fresh().sweeps.count(), "detect_all": lambda: detect(fresh()), "state_and_vector": lambda: feature_vectors(fresh()).count(),
    }
    queries["bars_15m"]()  # the first query pays for the JVM
    out = {}
    for name, run in queries.items():
        began = time.time()
        run()
        out[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
