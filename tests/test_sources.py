import lzma
import struct
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.cli import main
from tidemark.operators import bars as B
from tidemark.schema import Timeframe, instrument, timeframe
from tidemark.sources import candles, ingest
from tidemark.sources.store import CandleStore, ImmutableWriteError, ManifestStore, rollup_digest

HOUR = datetime(2024, 3, 8, 9, tzinfo=UTC)


def csv_tree(root, days=1):
    rng = np.random.default_rng(1)
    for symbol, start in (("EURUSD", 1.1), ("XAUUSD", 2000.0)):
        d = root / symbol
        d.mkdir(parents=True)
        lines, p = ["timestamp,open,high,low,close,volume"], start
        for i in range(288 * days):
            q = p * (1 + rng.normal() / 5000)
            hi, lo = max(p, q) * 1.0001, min(p, q) * 0.9999
            lines.append(f"2024-03-{4 + i // 288:02d}T{i % 288 // 12:02d}:{i % 12 * 5:02d}:00Z,{p},{hi},{lo},{q},{int(rng.integers(80, 400))}")
            p = q
        (d / "5m.csv").write_text("\n".join(lines) + "\n")


def test_names_are_parsed_or_refused():
    assert timeframe(" 1H ").minutes == 60 and instrument("eurusd ")[0] == "EURUSD"
    with pytest.raises(ValueError, match="one of"):
        timeframe("7m")
    with pytest.raises(ValueError, match="one of"):
        instrument("ABC")


def test_csv_is_half_open_and_strict(spark, tmp_path):
    csv_tree(tmp_path)
    src = candles.CsvSource(spark, str(tmp_path))
    assert isinstance(src, candles.Source) and src.supports("EURUSD", Timeframe("5m"))
    got = src.fetch("EURUSD", Timeframe("5m"), datetime(2024, 3, 4, 1, tzinfo=UTC), datetime(2024, 3, 4, 2, tzinfo=UTC))
    assert got.count() == 12 and got.agg(F.max("timestamp")).first()[0].hour == 1
    with pytest.raises(FileNotFoundError):
        src.fetch("EURUSD", Timeframe("1h"), HOUR, HOUR)
    with pytest.raises(ValueError, match="time zone"):
        src.fetch("EURUSD", Timeframe("5m"), datetime(2024, 3, 4), HOUR)
    (tmp_path / "EURUSD" / "1h.csv").write_text("timestamp,open\n")
    with pytest.raises(ValueError, match="has no"):
        src.fetch("EURUSD", Timeframe("1h"), HOUR, HOUR)


def test_tick_files_decode(spark, tmp_path):
    rows = [(0, 110010, 110000, 1.5, 2.5), (1500, 110020, 110012, 1.0, 1.0)]
    payload = lzma.compress(b"".join(struct.pack(">IIIff", *r) for r in rows) + b"\x00\x01\x02")
    got = candles.decode_ticks(payload, "EURUSD", HOUR)
    assert got["bid"].tolist() == [1.1, 1.10012] and got["ask"].tolist() == [1.1001, 1.1002] and set(got["trailing_bytes"]) == {3}
    assert str(got["timestamp"][1]) == "2024-03-08 09:00:01.500000"
    assert len(candles.decode_ticks(b"", "EURUSD", HOUR)) == 0
    with pytest.raises(ValueError, match="corrupt"):
        candles.decode_ticks(b"junk", "EURUSD", HOUR)
    p = tmp_path / candles.tick_path("EURUSD", HOUR)
    assert "/02/08/09h_ticks.bi5" in str(p)
    p.parent.mkdir(parents=True)
    p.write_bytes(candles.encode_ticks(rows))
    ticks = candles.read_ticks(spark, str(tmp_path))
    assert ticks.count() == 2 and ticks.filter("bid = 1.1").count() == 1
    bar = B.ticks_to_bars(ticks, Timeframe("1h"), seq="seq").first()
    assert (bar["open"], bar["close"], bar["volume"]) == (1.1, 1.10012, 2.0)


def test_native_candles_are_open_close_low_high(spark, tmp_path):
    rows = [(0, 110000, 110030, 109990, 110040, 5.0), (3600, 110030, 110030, 110030, 110030, 0.0), (7200, 110030, 110030, 110030, 110030, 3.0)]
    p = tmp_path / candles.native_candle_path("EURUSD", Timeframe("1h"), HOUR)
    p.parent.mkdir(parents=True)
    p.write_bytes(lzma.compress(b"".join(struct.pack(">iiiiif", *r) for r in rows)))
    got = candles.read_candles(spark, str(tmp_path), "1h").orderBy("timestamp").collect()
    assert len(got) == 2 and abs(got[0]["high"] - 1.1004) < 1e-9 and abs(got[0]["close"] - 1.1003) < 1e-9
    with pytest.raises(ValueError, match="1h and 1d"):
        candles.native_candle_path("EURUSD", Timeframe("4h"), HOUR)


def test_hours_and_months(spark):
    assert candles.hours_between(spark, datetime(2024, 1, 1, 22, 30, tzinfo=UTC), datetime(2024, 1, 2, 1, tzinfo=UTC)).count() == 3
    assert [str(r["month"]) for r in candles.months_between(spark, datetime(2024, 1, 31, tzinfo=UTC), datetime(2024, 3, 1, tzinfo=UTC)).collect()] == ["2024-01-01", "2024-02-01"]


def test_store_is_immutable_pruned_and_verified(spark, tmp_path):
    csv_tree(tmp_path / "csv")
    store, manifests = CandleStore(spark, str(tmp_path / "store")), ManifestStore(str(tmp_path / "m"))
    args = ["--store", str(tmp_path / "store"), "--manifests", str(tmp_path / "m")]
    go = [*args, "ingest", "--source", str(tmp_path / "csv"), "--version", "v1", "--start", "2024-03-04", "--end", "2024-03-05"]
    assert main(go, spark) == 0
    m5 = Timeframe("5m")
    assert store.years("EURUSD", m5) == [2024] and store.read("EURUSD", m5).count() == 288
    assert store.read("EURUSD", m5, datetime(2024, 3, 4, 6, tzinfo=UTC), datetime(2024, 3, 4, 7, tzinfo=UTC)).count() == 12
    assert store.read("EURUSD", Timeframe("1d")).count() == 0
    plan = store.read("EURUSD", m5, HOUR, HOUR)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan[plan.index("PartitionFilters") :][:300]
    with pytest.raises(ImmutableWriteError):
        store.write(store.read("EURUSD", m5))
    with pytest.raises(ImmutableWriteError):
        manifests.write("v1", {})
    assert manifests.versions() == ["v1"] and main([*args, "verify", "--version", "v1"], spark) == 0
    part = next((tmp_path / "store/symbol=EURUSD/timeframe=5m/year=2024").glob("*.parquet"))
    part.unlink()
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    other = next((tmp_path / "store/symbol=XAUUSD/timeframe=5m/year=2024").glob("*.parquet"))
    for f in (tmp_path / "store/symbol=XAUUSD/timeframe=5m/year=2024").glob(".*.crc"):
        f.unlink()
    other.write_bytes(other.read_bytes() + b"x")
    assert set(manifests.verify("v1", store)) == {"MISSING:EURUSD/5m/2024", "CHANGED:XAUUSD/5m/2024"}
    go[go.index("v1")] = "v2"
    assert main([*go, "--symbols", "EURUSD", "--timeframes", "5m", "1h", "--overwrite"], spark) == 1  # no 1h file; 5m is stored
    assert [s["timeframe"] for s in manifests.read("v2")["series"]] == ["5m"]


def test_ticks_to_every_timeframe(spark, tmp_path):
    rows = [("EURUSD", datetime(2024, 3, 4, h, m, tzinfo=UTC), 1.1 + h / 1000 + m / 1e5, 1.2 + h / 1000, 1.0, 1.0, h * 60 + m) for h in range(24) for m in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, timestamp timestamp, bid double, ask double, bid_volume double, ask_volume double, seq long")
    got = ingest.backfill(spark, ticks, CandleStore(spark, str(tmp_path / "s")), ManifestStore(str(tmp_path / "m")), "v")
    assert sorted(s["timeframe"] for s in got["series"]) == ["15m", "1d", "1h", "1m", "4h", "5m"]
    assert CandleStore(spark, str(tmp_path / "s")).read("EURUSD", Timeframe("1d")).first()["volume"] == 1440


def test_rollup_does_not_depend_on_order(spark):
    rows = [("a", "x", 1), ("b", "y", 0)]
    one, two = (rollup_digest(spark.createDataFrame(r, "path string, sha string, n_bytes long")).first() for r in (rows, rows[::-1]))
    assert one == two and one["empty"] == 1


def test_a_year_can_be_written_anew_from_the_store_itself(spark, tmp_path):
    rows = [("EURUSD", datetime(y, 3, 4, 1, m, tzinfo=UTC), 1.0, 2.0, 0.5, 1.5, float(m)) for y in (2023, 2024) for m in range(3)]
    bars = spark.createDataFrame([(t, s, "1m", *p) for s, t, *p in rows], "timestamp timestamp, symbol string, timeframe string, open double, high double, low double, close double, volume double")
    store = CandleStore(spark, f"file://{tmp_path}/s")
    assert len(store.write(bars)) == 2
    with pytest.raises(ImmutableWriteError):
        store.write(bars)
    again = store.read("EURUSD", Timeframe("1m")).filter("year(timestamp) = 2024").unionByName(bars.filter("minute(timestamp) = 0").withColumn("timestamp", bars.timestamp + timedelta(hours=5)).filter("year(timestamp) = 2024"))
    assert store.write(again, overwrite=True) == [("EURUSD", "1m", 2024)]
    assert store.read("EURUSD", Timeframe("1m")).count() == 7 and store.years("EURUSD", Timeframe("1m")) == [2023, 2024]
    assert not list((tmp_path / "s").glob("_*"))
