"""Sessions, trading days and weeks, and the New York midnight open.

Windows are generated per definition and local date and turned into UTC instants, so
daylight saving is the time zone's own. A bar meets the windows of its own local date
and the one before: equi-joins on the date, then containment."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import KEY, NEW_YORK, SESSIONS


def session_definitions(source: str | None = None) -> tuple[tuple[str, str, str, str], ...]:
    """The defaults, or those of JSON text or of a JSON file: a list of objects with name,
    timezone, start and end."""
    if not source:
        return SESSIONS
    text = source if source.lstrip().startswith("[") else Path(source).read_text()
    rows = json.loads(text)
    out = []
    for r in rows:
        if set(r) != {"name", "timezone", "start", "end"} or not all(isinstance(v, str) and v for v in r.values()):
            raise ValueError(f"a session needs name, timezone, start and end: {r!r}")
        out.append((r["name"], r["timezone"], r["start"], r["end"]))
    if len({r[0] for r in out}) != len(out):
        raise ValueError("session names must differ")
    return tuple(out)


def to_utc(local: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(local, zone)


def dst_anomaly(local: Column, zone: Column | str) -> Column:
    """nonexistent where clocks jump over a local time, ambiguous where it comes twice."""
    u = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(u, zone)
    again = F.from_utc_timestamp(u + F.expr("INTERVAL '1' HOUR"), zone)
    return F.when(back != local, "nonexistent").when(again == local, "ambiguous").otherwise("none")


def zones_of(definitions=SESSIONS) -> Column:
    """The names and time zones of a handful of definitions, as an array."""
    return F.array(*[F.struct(F.lit(d[0]).alias("name"), F.lit(d[1]).alias("zone")) for d in definitions])


def windows(spark: SparkSession, span: DataFrame, definitions=SESSIONS) -> DataFrame:
    """name, local_date, start_utc, end_utc of every window that meets the span (one row:
    first and last instants). A window whose end is not after its start crosses midnight."""
    defs = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("name", "zone", "open", "shut"), d, strict=True)]) for d in definitions])
    days = span.select(F.explode(F.sequence(F.date_sub(F.to_date("first"), 2), F.date_add(F.to_date("last"), 2))).alias("local_date"), "first", "last")
    rows = days.withColumn("d", F.explode(defs)).select("local_date", "first", "last", "d.*")
    at = lambda date, time: F.to_utc_timestamp(F.concat_ws(" ", date.cast("string"), F.concat(F.col(time), F.lit(":00"))).cast("timestamp"), F.col("zone"))
    shut_on = F.when(F.col("shut") <= F.col("open"), F.date_add("local_date", 1)).otherwise(F.col("local_date"))
    rows = rows.withColumn("start_utc", at(F.col("local_date"), "open")).withColumn("end_utc", at(shut_on, "shut"))
    return rows.filter((F.col("end_utc") > F.col("first")) & (F.col("start_utc") <= F.col("last"))).select("name", "zone", "local_date", "start_utc", "end_utc")


def span_of(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("timestamp").alias("first"), F.max("close_time").alias("last"))


def members(bars: DataFrame, wins: DataFrame, definitions=SESSIONS) -> DataFrame:
    """Bars that lie wholly inside a window; definitions: those that the windows are of."""
    b = bars.withColumn("_z", F.explode(zones_of(definitions))).select(*bars.columns, "_z.*")
    day = F.to_date(F.from_utc_timestamp("timestamp", F.col("zone")))
    b = b.withColumn("local_date", F.explode(F.array(day, F.date_sub(day, 1))))
    return b.join(wins, ["name", "zone", "local_date"]).filter((F.col("timestamp") >= F.col("start_utc")) & (F.col("close_time") <= F.col("end_utc")))


def _extremes(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*KEY, *by).agg(
        F.min_by("open", "timestamp").alias("open_price"), F.max("high").alias("high_price"), F.min("low").alias("low_price"), F.max_by("close", "timestamp").alias("close_price"),
        F.min_by("timestamp", F.struct(-F.col("high"), F.col("timestamp"))).alias("high_timestamp"), F.min_by("timestamp", F.struct("low", "timestamp")).alias("low_timestamp"), F.count("*").alias("bar_count"), F.max("close_time").alias("observed_end"), F.min("timestamp").alias("open_timestamp"), F.max("timestamp").alias("close_timestamp"),
    )


def sessions(bars: DataFrame, wins: DataFrame, definitions=SESSIONS) -> DataFrame:
    """Completed occurrences: the series has a bar that closes at or after the window's end."""
    got = _extremes(members(bars, wins, definitions), "name", "local_date", "start_utc", "end_utc")
    end = bars.groupBy(*KEY).agg(F.max("close_time").alias("_end"))
    return got.join(end, list(KEY)).filter("_end >= end_utc").drop("_end", "observed_end").withColumn("confirmation_timestamp", F.col("end_utc"))


def session_state(bars: DataFrame, wins: DataFrame, as_of, definitions=SESSIONS) -> DataFrame:
    """What each session looks like so far; of each name the window that started last."""
    t = F.lit(as_of).cast("timestamp")
    got = _extremes(members(bars.filter(F.col("close_time") <= t), wins.filter(F.col("start_utc") <= t), definitions), "name", "local_date", "start_utc", "end_utc")
    close = bars.filter(F.col("close_time") <= t).groupBy(*KEY).agg(F.max_by("close", "timestamp").alias("_price"))
    rows = got.join(close, list(KEY)).withColumn("is_active", (F.col("start_utc") <= t) & (t < F.col("end_utc"))).withColumn("is_complete", t >= F.col("end_utc"))
    rows = rows.withColumn("position_in_range", F.try_divide(F.col("_price") - F.col("low_price"), F.col("high_price") - F.col("low_price"))).drop("_price")
    cols = [c for c in rows.columns if c not in (*KEY, "name")]
    return rows.groupBy(*KEY, "name").agg(F.max_by(F.struct(*cols), "start_utc").alias("s")).select(*KEY, "name", "s.*")


TRADING_DAY = (("trading_day", NEW_YORK, "17:00", "17:00"),)


def trading_days(bars: DataFrame, wins: DataFrame) -> DataFrame:
    """Highs and lows of 17:00-to-17:00 New York days, with completed."""
    end = bars.groupBy(*KEY).agg(F.max("close_time").alias("_end"))
    got = _extremes(members(bars, wins, TRADING_DAY), "local_date", "start_utc", "end_utc").join(end, list(KEY))
    return got.withColumn("completed", F.col("_end") >= F.col("end_utc")).drop("_end")


def trading_weeks(bars: DataFrame, wins: DataFrame) -> DataFrame:
    """Weeks of trading days that begin Sunday to Thursday; a week ends with Thursday's day."""
    days = members(bars, wins, TRADING_DAY).filter(F.weekday("local_date").isin(6, 0, 1, 2, 3))
    days = days.withColumn("week", F.date_sub("local_date", F.expr("(weekday(local_date) + 1) % 7")))
    got = _extremes(days, "week")
    last = F.to_utc_timestamp(F.concat_ws(" ", F.date_add("week", 5).cast("string"), F.lit("17:00:00")).cast("timestamp"), NEW_YORK)
    first = F.to_utc_timestamp(F.concat_ws(" ", F.col("week").cast("string"), F.lit("17:00:00")).cast("timestamp"), NEW_YORK)
    end = bars.groupBy(*KEY).agg(F.max("close_time").alias("_end"))
    return got.withColumn("start_utc", first).withColumn("end_utc", last).join(end, list(KEY)).withColumn("completed", F.col("_end") >= F.col("end_utc")).drop("_end")


def daily_opens(bars: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    """The bar that opens exactly at local midnight; known at that instant."""
    day = F.to_date(F.from_utc_timestamp("timestamp", zone))
    midnight = F.to_utc_timestamp(day.cast("timestamp"), zone)
    rows = bars.withColumn("trading_date", day).filter(F.col("timestamp") == midnight)
    return rows.select(*KEY, "trading_date", F.col("open").alias("price_level"), F.col("timestamp").alias("event_timestamp"), F.col("timestamp").alias("confirmation_timestamp"), F.concat_ws(":", F.lit("tdo"), *KEY, F.col("trading_date").cast("string")).alias("level_id"))
