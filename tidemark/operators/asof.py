"""Point-in-time joins and filters.

A row is observable at `as_of` when its confirmation_timestamp is not later. Joins
across time are a union and one window per series and cell of time, never a nested loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import KEY, Timeframe


def observable(rows: DataFrame, as_of) -> DataFrame:
    """The rows a decision at as_of may use; equality is observable."""
    return rows.filter(F.col("confirmation_timestamp") <= F.lit(as_of).cast("timestamp"))


def confirmed_within(rows: DataFrame, start, end) -> DataFrame:
    return rows.filter(F.col("confirmation_timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def leaks(rows: DataFrame, as_of=None) -> DataFrame:
    """Rows that break the contract: confirmed before they happened, or after as_of."""
    bad = F.col("confirmation_timestamp") < F.col("event_timestamp")
    if as_of is not None:
        bad = bad | (F.col("confirmation_timestamp") > F.lit(as_of).cast("timestamp"))
    return rows.filter(bad)


#: Seconds of a cell: what one task sorts of a series at a time.
CELL_SECONDS = 7 * 86400


@dataclass(frozen=True)
class AsOf:
    """What an as-of join takes from the right: rows, their time, columns, and which of rows
    at one time wins (the greatest)."""

    rows: DataFrame
    time: str
    columns: list[str]
    tiebreak: list[Column] = field(default_factory=list)


def cell_of(time: str) -> Column:
    return F.floor(F.unix_seconds(time) / CELL_SECONDS)


def asof_joins(left: DataFrame, left_time: str, rights: list[AsOf], by: tuple[str, ...] = KEY) -> DataFrame:
    """Every left row with the columns, of each right side, of its last row whose time is not
    later; null before the first.

    All sides meet in one union, in cells of time; what a cell leaves to later ones is added
    up over the cells, so no task sorts a whole series. Reads left twice."""
    names = [f"_right{i}" for i in range(len(rights))]
    both = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    for name, r in zip(names, rights):
        rows = r.rows.filter(F.col(r.time).isNotNull())
        if r.tiebreak:
            last = Window.partitionBy(*by, r.time).orderBy(*[c.desc() for c in r.tiebreak])
            rows = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        both = both.unionByName(rows.select(*by, F.col(r.time).alias("_t"), F.lit(0).alias("_side"), F.struct(*r.columns).alias(name)), allowMissingColumns=True)
    both = both.withColumn("_cell", cell_of("_t"))
    within = Window.partitionBy(*by, "_cell").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy(*by, "_cell").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_t"))).alias(n) for n in names])
    cells = cells.select(*by, "_cell", *[F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_before") for n in names])
    got = both.withColumns({n: F.last(n, ignorenulls=True).over(within) for n in names}).filter("_side = 1").join(cells, [*by, "_cell"], "left")
    got = got.withColumns({n: F.coalesce(n, f"{n}_before") for n in names})
    return got.select("_row.*", *[F.col(f"{n}.{c}").alias(c) for n, r in zip(names, rights) for c in r.columns])


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str], tiebreak: list[Column] | None = None, by: tuple[str, ...] = KEY) -> DataFrame:
    """asof_joins with one right side."""
    return asof_joins(left, left_time, [AsOf(right, right_time, columns, tiebreak or [])], by)


def latest_closed_bar(bars: DataFrame, as_of) -> DataFrame:
    """Per series the last bar that had closed."""
    seen = bars.filter(F.col("close_time") <= F.lit(as_of).cast("timestamp"))
    return seen.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in bars.columns if c not in KEY]), "timestamp").alias("_b")).select(*KEY, "_b.*")


def align_context(base: DataFrame, higher: DataFrame, tf_base: Timeframe, tf_higher: Timeframe, suffix: str = "_htf", columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Each base bar with the last higher-timeframe bar that had closed by its close."""
    if not tf_base.minutes < tf_higher.minutes:
        raise ValueError(f"{tf_higher.name} is not higher than {tf_base.name}")
    names = {c: f"{c}{suffix}" for c in (*columns, "timestamp", "close_time")}
    up = higher.select("symbol", *[F.col(c).alias(n) for c, n in names.items()])
    return asof_join(base, up, "close_time", names["close_time"], list(names.values()), by=("symbol",))
