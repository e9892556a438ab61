"""First-hit search and lifecycle helpers over a series, as equi-joins.

The bars of a series are stored as a tree of arrays: a leaf holds 2 ** FAN_LOG2 bars, an inner
node the extremes of as many nodes below it, the top node those of all below it. "The first bar from `start` on whose value is
beyond `level`" climbs to the first node that has one and comes down to the bar; each
step joins a search to one row and looks inside its array. Cost is the number of
levels, whatever the distance, and no join is an inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import cell_of
from tidemark.schema import KEY

#: Bars of a leaf and nodes below an inner node, as a power of two. The top has one entry for each
#: 2 ** (FAN_LOG2 * (LEVELS - 1)) bars of its series.
FAN_LOG2, LEVELS = 7, 3


def _parent(child: str, lv: int) -> Column:
    """The node of level lv that holds the entry."""
    return F.shiftright(child, FAN_LOG2) if lv < LEVELS - 1 else F.lit(0)


def tree(bars: DataFrame, value: Column, high: bool) -> list[DataFrame]:
    """Per level: KEY, node, xs (values in order, null where none). The last level is
    one node, 0, of as many values as the series needs."""
    rows = bars.select(*KEY, F.col("idx").alias("child"), value.alias("x"))
    out = []
    for lv in range(LEVELS):
        rows = rows.withColumn("node", _parent("child", lv)).groupBy(*KEY, "node").agg(F.array_sort(F.collect_list(F.struct("child", "x"))).alias("xs"))
        out.append(rows)
        best = F.array_max(F.transform("xs", lambda s: s["x"])) if high else F.array_min(F.transform("xs", lambda s: s["x"]))
        rows = rows.select(*KEY, F.col("node").alias("child"), best.alias("x"))
    return out


def first_hit(items: DataFrame, bars: DataFrame, value: Column, above: bool, start: str, level: str, inclusive: bool = False, out: str = "hit_idx") -> DataFrame:
    """items with `out`: idx of the first bar at or after items.start whose value is
    beyond items.level (strictly unless inclusive); null if there is none."""
    nodes = tree(bars, value, above)

    def inside(at: Column) -> Column:
        ok = (lambda s: s["x"] >= F.col(level)) if above and inclusive else (lambda s: s["x"] > F.col(level)) if above else (lambda s: s["x"] <= F.col(level)) if inclusive else (lambda s: s["x"] < F.col(level))
        return F.get(F.filter("xs", lambda s: (s["child"] >= at) & ok(s)), F.lit(0))["child"]

    df = items.withColumn("_p", F.col(start).cast("long")).withColumn("_found", F.lit(None).cast("int")).withColumn("_hit", F.lit(None).cast("long"))
    for lv, node in enumerate(nodes):
        here = node.select(*KEY, F.col("node").alias("_node"), "xs")
        df = df.withColumn("_node", _parent("_p", lv)).join(here, [*KEY, "_node"], "left")
        hit = F.when(F.col("_found").isNull(), inside(F.col("_p")))
        df = df.withColumn("_h", hit).withColumn("_hit", F.coalesce("_hit", "_h")).withColumn("_found", F.coalesce("_found", F.when(F.col("_h").isNotNull(), F.lit(lv))))
        df = df.withColumn("_p", F.shiftright("_p", FAN_LOG2) + 1).drop("xs", "_h", "_node")
    for lv in range(LEVELS - 2, -1, -1):
        here = nodes[lv].select(*KEY, F.col("node").alias("_node"), "xs")
        df = df.withColumn("_node", F.when(F.col("_found") > lv, F.col("_hit"))).join(here, [*KEY, "_node"], "left")
        df = df.withColumn("_hit", F.when(F.col("_found") > lv, inside(F.lit(-1))).otherwise(F.col("_hit"))).drop("xs", "_node")
    return df.withColumn(out, F.col("_hit")).drop("_p", "_found", "_hit")


def first_hit_two_sided(items: DataFrame, bars: DataFrame, up: Column, down: Column, start: str, level: str, above: str, inclusive: bool = False, out: str = "hit_idx") -> DataFrame:
    """first_hit where a row's boolean column `above` tells the side."""
    a = first_hit(items.filter(F.col(above)), bars, up, True, start, level, inclusive, out)
    b = first_hit(items.filter(~F.col(above)), bars, down, False, start, level, inclusive, out)
    return a.unionByName(b)


def bars_at(items: DataFrame, bars: DataFrame, idx: str, columns: dict[str, str]) -> DataFrame:
    """items with columns of the bar at items.idx (null if none); columns: bar's name -> new name."""
    b = bars.select(*KEY, F.col("idx").alias(idx), *[F.col(c).alias(n) for c, n in columns.items()])
    return items.join(b, [*KEY, idx], "left")


def first_index_at(items: DataFrame, bars: DataFrame, time: str, bar_time: str = "timestamp", out: str = "start_idx") -> DataFrame:
    """items with the idx of the first bar whose time is at or after items.time."""
    a = items.select(*KEY, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(*items.columns).alias("_row"))
    b = bars.select(*KEY, F.col(bar_time).alias("_t"), F.lit(1).alias("_side"), F.col("idx").alias("_i"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_cell", cell_of("_t"))
    within = Window.partitionBy(*KEY, "_cell").orderBy("_t", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy(*KEY).orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    cells = both.groupBy(*KEY, "_cell").agg(F.min("_i").alias("_i")).select(*KEY, "_cell", F.first("_i", ignorenulls=True).over(later).alias("_after"))
    got = both.withColumn("_i", F.first("_i", ignorenulls=True).over(within)).filter("_side = 0").join(cells, [*KEY, "_cell"], "left")
    return got.select("_row.*", F.coalesce("_i", "_after").alias(out))


def fill_stream(zones: DataFrame, bars: DataFrame, zone_id: str, start: str, partial: float = 0.0, full: float = 1.0) -> DataFrame:
    """How zones (direction, top, bottom, first bar `start`) are filled: one row each time
    the fill deepens beyond the partial threshold, until it is full.

    A bullish zone fills by lows from its top down, any other by highs from its bottom up.
    Only leaves that reach deeper than all before are opened, so a zone costs the leaves
    of its life, not its bars."""
    flip = F.when(F.col("direction") == "bearish", F.lit(-1.0)).otherwise(F.lit(1.0))
    z = zones.select(*KEY, F.col(zone_id).alias("zone_id"), "direction", "top", "bottom", F.col(start).cast("long").alias("start")).filter("start IS NOT NULL")
    # In flipped prices every zone is entered from above: near is its entry edge.
    z = z.withColumn("_flip", flip).withColumn("_near", F.when(flip > 0, F.col("top")).otherwise(-F.col("bottom")))
    floor_ = z.withColumn("_full", F.col("_near") - F.lit(full) * (F.col("top") - F.col("bottom")) if full != 1.0 else F.when(F.col("_flip") > 0, F.col("bottom")).otherwise(-F.col("top")))
    lows = bars.select(*KEY, "idx", F.explode(F.array(F.struct(F.lit(1.0).alias("_flip"), F.col("low").alias("x")), F.struct(F.lit(-1.0).alias("_flip"), (-F.col("high")).alias("x")))).alias("e")).select(*KEY, "idx", "e.*")
    leaves = lows.withColumn("leaf", F.shiftright("idx", FAN_LOG2)).groupBy(*KEY, "_flip", "leaf").agg(F.min("x").alias("low_x"), F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("xs"))
    lo = floor_.filter("_flip > 0")
    hi = floor_.filter("_flip < 0")
    ends = first_hit(lo, bars, F.col("low"), False, "start", "_full", inclusive=True, out="end").unionByName(first_hit(hi.withColumn("_full", -F.col("_full")), bars, F.col("high"), True, "start", "_full", inclusive=True, out="end").withColumn("_full", -F.col("_full")))
    top = bars.groupBy(*KEY).agg(F.max("idx").alias("_max"))
    life = ends.join(top, list(KEY)).withColumn("_last", F.coalesce("end", "_max")).filter("_last >= start")
    life = life.withColumn("leaf", F.explode(F.sequence(F.shiftright("start", FAN_LOG2), F.shiftright("_last", FAN_LOG2))))
    seen = life.join(leaves, [*KEY, "_flip", "leaf"])
    order = Window.partitionBy(*KEY, "zone_id").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    first_leaf = F.col("leaf") == F.shiftright("start", FAN_LOG2)
    # Of the first leaf only bars of the zone's life count.
    own = F.when(first_leaf, F.array_min(F.transform(F.filter("xs", lambda s: s["idx"] >= F.col("start")), lambda s: s["x"]))).otherwise(F.col("low_x"))
    seen = seen.withColumn("_own", own).withColumn("_before", F.least(F.min("_own").over(order), F.col("_near")))
    deeper = seen.withColumn("_before", F.coalesce("_before", "_near")).filter(F.col("_own") < F.col("_before"))
    rows = deeper.select(*KEY, "zone_id", "direction", "top", "bottom", "_flip", "_near", "_before", "_last", "start", F.explode("xs").alias("e")).filter("e.idx >= start AND e.idx <= _last")
    w = Window.partitionBy(*KEY, "zone_id").orderBy("e.idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_prev", F.least(F.coalesce(F.min("e.x").over(w), F.col("_near")), F.col("_near"))).filter("e.x < _prev")
    deepest = F.col("e.x") * F.col("_flip")
    span = F.col("top") - F.col("bottom")
    raw = F.when(F.col("_flip") > 0, (F.col("top") - deepest) / span).otherwise((deepest - F.col("bottom")) / span)
    rows = rows.withColumn("fill_percentage", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).withColumn("deepest_price", deepest)
    before = F.lag("fill_percentage").over(Window.partitionBy(*KEY, "zone_id").orderBy("e.idx"))
    rows = rows.withColumn("_b", F.coalesce(before, F.lit(0.0))).filter((F.col("fill_percentage") > F.col("_b")) & ((F.col("fill_percentage") >= full) | (F.col("fill_percentage") > partial)))
    status = F.when(F.col("fill_percentage") >= full, F.lit("mitigated")).otherwise(F.lit("partially_filled"))
    rows = rows.select(*KEY, "zone_id", F.col("e.idx").alias("idx"), "fill_percentage", "deepest_price", status.alias("status_after"))
    return bars_at(rows, bars, "idx", {"timestamp": "event_timestamp", "close_time": "confirmation_timestamp"})
