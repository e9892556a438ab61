"""Market state at each bar close, and the feature vector.

What is alive at a bar (gaps, blocks, levels) is an interval of bars per item. Each
interval is cut into nodes of a tree over the bars (single bars, blocks of FAN, blocks of
FAN * FAN), at most a few per level, items are aggregated per node, and a bar reads the
three nodes above it: every item that is alive there is in exactly one. So counts, the
latest and the nearest come from equi-joins, and cost follows items and bars, not their
product. What is only "the latest so far" comes from one pass in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import AsOf, asof_joins
from tidemark.operators.blocks import zone_fills
from tidemark.operators.calendar import zones_of
from tidemark.operators.ranges import zone_of
from tidemark.operators.search import bars_at, first_hit_two_sided, first_index_at
from tidemark.plans.market import Market
from tidemark.schema import BEAR, BULL, KEY, NEW_YORK, point_of
from tidemark.sources.shared import kept

FAN_LOG2 = 6
FEATURE_VERSION = "r2-07.1"
# The order of the feature columns.
FEATURES = (
    "close", "distance_from_true_daily_open_points", "distance_from_equilibrium_points", "percentage_position", "is_premium", "is_discount", "is_equilibrium", "dealing_range_width_points", "dealing_range_direction_code",
    "structure_state_code", "structure_direction_code", "latest_break_type_code", "latest_break_direction_code", "has_bos", "has_mss", "has_choch", "bos_count", "mss_count", "choch_count", "bars_since_structural_break", "distance_from_structural_level_points",
    "buy_side_liquidity_count", "sell_side_liquidity_count", "nearest_buy_side_points", "nearest_sell_side_points", "has_recent_sweep", "latest_sweep_side_code", "latest_sweep_is_rejection", "bars_since_sweep",
    "bullish_fvg_count", "bearish_fvg_count", "nearest_bullish_fvg_points", "nearest_bearish_fvg_points", "ifvg_count", "latest_ifvg_direction_code", "bpr_count",
    "bullish_order_block_count", "bearish_order_block_count", "bullish_breaker_count", "bearish_breaker_count", "latest_breaker_direction_code", "rdrb_count", "has_cisd", "delivery_state_code", "bars_since_cisd", "unicorn_count", "latest_unicorn_direction_code",
    "trading_day_age_minutes", "session_elapsed_minutes", "minute_of_session", "active_session_count", "day_of_week", "hour_of_day", "bias_code", "bullish_evidence_count", "bearish_evidence_count",
)


def way_code(direction: str | Column) -> Column:
    c = F.col(direction) if isinstance(direction, str) else direction
    return F.when(c == BULL, 1).when(c == BEAR, -1).when(c.isin("neutral", "undefined"), 0)


def zones(m: Market) -> DataFrame:
    """Every zone of every kind: kind, id, direction, top, bottom, times."""
    parts = []
    for kind, df, id_ in (("fvg", m.fvg, "zone_id"), ("ifvg", m.ifvg, "ifvg_id"), ("bpr", m.bpr, "bpr_id"), ("rdrb", m.rdrb, "rdrb_id"), ("ob", m.blocks, "order_block_id"), ("breaker", m.breakers, "breaker_id"), ("unicorn", m.unicorns, "unicorn_id")):
        source = F.col("source_breaker_id") if kind == "unicorn" else F.lit(None).cast("string")
        parts.append(df.select(*KEY, F.lit(kind).alias("kind"), F.col(id_).alias("id"), "direction", "top", "bottom", "event_timestamp", "confirmation_timestamp", source.alias("parent")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zone_ends(m: Market) -> DataFrame:
    """zones with the bars `start`, at whose close each is first known, and `filled`, that
    reaches its far edge (null if none); and the failure of an order block and the filling
    of a unicorn's breaker, as bar (`own_end`). All with the instants these bars close."""
    z = first_index_at(zones(m), m.bars, "confirmation_timestamp", "timestamp", "_fill_from")
    z = first_index_at(z, m.bars, "confirmation_timestamp", "close_time", "start")
    z = z.withColumn("_above", F.col("direction") == BEAR).withColumn("_level", F.when(F.col("_above"), F.col("top")).otherwise(F.col("bottom")))
    z = kept(first_hit_two_sided(z, m.bars, F.col("high"), F.col("low"), "_fill_from", "_level", "_above", inclusive=True, out="filled"), "zone-ends").drop("_fill_from", "_above", "_level")
    failed = m.failures.select(F.lit("ob").alias("kind"), F.col("order_block_id").alias("id"), F.col("failure_idx").alias("own_end"))
    parents = z.filter("kind = 'breaker'").select(F.col("id").alias("parent"), F.col("filled").alias("_parent_end"))
    z = z.join(failed, ["kind", "id"], "left").join(parents, "parent", "left").withColumn("own_end", F.coalesce("own_end", "_parent_end")).drop("_parent_end")
    z = bars_at(z, m.bars, "filled", {"close_time": "filled_at"})
    return bars_at(z, m.bars, "own_end", {"close_time": "ended_at"})


def zone_status(ends: DataFrame, as_of=None) -> DataFrame:
    """zone_ends with status as of an instant (zones not known by then are left out), or at
    the end of the bars: invalidated by an end of its own, mitigated once filled, else
    active."""
    t = None if as_of is None else F.lit(as_of).cast("timestamp")
    seen = lambda c: F.col(c).isNotNull() if t is None else F.coalesce(F.col(c) <= t, F.lit(False))
    known = ends if t is None else ends.filter(F.col("confirmation_timestamp") <= t)
    return known.withColumn("status", F.when(seen("ended_at"), "invalidated").when(seen("filled_at"), "mitigated").otherwise("active"))


def unicorn_lifecycle(m: Market) -> DataFrame:
    """Per unicorn: when a bar first enters it (retested_at), when it is filled
    (mitigated_at), when its breaker is (invalidated_at), and its status at the end."""
    fills = zone_fills(m.unicorns, m.bars, "unicorn_id").groupBy("zone_id").agg(F.min("confirmation_timestamp").alias("retested_at"))
    z = zone_status(zone_ends(m)).filter("kind = 'unicorn'").join(fills.withColumnRenamed("zone_id", "id"), "id", "left")
    status = F.when((F.col("status") == "active") & F.col("retested_at").isNotNull(), "partially_filled").otherwise(F.col("status"))
    return z.select(*KEY, F.col("id").alias("unicorn_id"), "direction", "confirmation_timestamp", "retested_at", F.col("filled_at").alias("mitigated_at"), F.col("ended_at").alias("invalidated_at"), status.alias("status"))


def lifetimes(m: Market) -> DataFrame:
    """kind, id, direction, value, times, and the bars [start, end) at whose closes an item
    is alive; items that never are (dead before they are known) are left out.

    Zones die when they are filled; an order block also when it fails, a unicorn also when
    its breaker is filled; levels die when they are swept."""
    z = zone_ends(m).filter("start IS NOT NULL").withColumn("end", F.least("filled", "own_end"))
    z = z.select(*KEY, "kind", "id", "direction", ((F.col("top") + F.col("bottom")) / 2).alias("value"), "event_timestamp", "confirmation_timestamp", "start", "end")
    lv = first_index_at(m.levels, m.bars, "confirmation_timestamp", "close_time", "start").filter("start IS NOT NULL")
    lv = lv.join(m.sweeps.select("level_id", F.col("idx").alias("end")), "level_id", "left")
    lv = lv.select(*KEY, F.lit("level").alias("kind"), F.col("level_id").alias("id"), F.col("side").alias("direction"), F.col("price_level").alias("value"), F.col("created_timestamp").alias("event_timestamp"), "confirmation_timestamp", "start", "end")
    return kept(z.unionByName(lv).filter("end IS NULL OR start < end"), "lifetimes")


def _span(lo: Column, hi: Column) -> Column:
    """lo .. hi - 1, empty if there is nothing between."""
    return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))


def _nodes(start: Column, end: Column) -> Column:
    """The tree nodes (level, node) that exactly cover [start, end)."""
    up = lambda c: F.shiftright(c + ((1 << FAN_LOG2) - 1), FAN_LOG2)
    down = lambda c: F.shiftright(c, FAN_LOG2)
    at = lambda level, xs: F.transform(xs, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))

    def cover(level: int, lo: Column, hi: Column) -> Column:
        if level == 2:
            return at(2, _span(lo, hi))
        a, b = up(lo), down(hi)
        inner = F.concat(at(level, _span(lo, F.shiftleft(a, FAN_LOG2))), at(level, _span(F.shiftleft(b, FAN_LOG2), hi)), cover(level + 1, a, b))
        return F.when(a < b, inner).otherwise(at(level, _span(lo, hi)))

    return cover(0, start, end)


COUNTS = {
    "buy_side_liquidity_count": ("level", "buy_side"), "sell_side_liquidity_count": ("level", "sell_side"), "bullish_fvg_count": ("fvg", BULL), "bearish_fvg_count": ("fvg", BEAR), "ifvg_count": ("ifvg", None), "bpr_count": ("bpr", None),
    "bullish_order_block_count": ("ob", BULL), "bearish_order_block_count": ("ob", BEAR), "bullish_breaker_count": ("breaker", BULL), "bearish_breaker_count": ("breaker", BEAR), "rdrb_count": ("rdrb", None), "unicorn_count": ("unicorn", None),
}
NEAREST = {"nearest_buy_side_points": ("level", "buy_side"), "nearest_sell_side_points": ("level", "sell_side"), "nearest_bullish_fvg_points": ("fvg", BULL), "nearest_bearish_fvg_points": ("fvg", BEAR)}
LATEST = {
    "latest_bullish_fvg": ("fvg", BULL), "latest_bearish_fvg": ("fvg", BEAR), "latest_ifvg": ("ifvg", None), "latest_bpr": ("bpr", None), "latest_bullish_order_block": ("ob", BULL), "latest_bearish_order_block": ("ob", BEAR),
    "latest_breaker": ("breaker", None), "latest_rdrb": ("rdrb", None), "latest_unicorn": ("unicorn", None),
}


def _is(kind: str, direction: str | None) -> Column:
    return (F.col("kind") == kind) & (F.lit(True) if direction is None else F.col("direction") == direction)


def _nearest(cut: DataFrame, bars: DataFrame) -> DataFrame:
    """KEY, idx and per kind of NEAREST the id, value and distance of the closest alive item
    (of several the smallest id). Bars and items of a node are sorted by price together, so
    a bar finds its two neighbours without a scan of the node's items."""
    which = F.coalesce(*[F.when(_is(*k), F.lit(c)) for c, k in NEAREST.items()])
    items = cut.withColumn("which", which).filter("which IS NOT NULL").groupBy(*KEY, "level", "node", "which", F.col("value").alias("x")).agg(F.min("id").alias("id"))
    items = items.select(*KEY, "level", "node", "which", "x", F.struct("x", "id").alias("item"), F.lit(0).alias("side"))
    probes = bars.withColumn("which", F.explode(F.array(*[F.lit(c) for c in NEAREST]))).select(*KEY, "level", "node", "which", F.col("close").alias("x"), F.lit(1).alias("side"), "idx")
    w = Window.partitionBy(*KEY, "level", "node", "which").orderBy("x", "side")
    rows = items.unionByName(probes, allowMissingColumns=True)
    rows = rows.withColumn("under", F.last("item", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("over", F.first("item", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("side = 1")
    best = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["x"] - F.col("x")).alias("distance"), F.col(c)["id"].alias("id"), F.col(c)["x"].alias("price")))
    rows = rows.withColumn("best", F.least(best("under"), best("over")))
    return rows.groupBy(*KEY, "idx").agg(*[F.min(F.when(F.col("which") == c, F.col("best"))).alias(f"_{c}") for c in NEAREST])


def alive_features(m: Market, items: DataFrame) -> DataFrame:
    """KEY, idx and what the alive items say: counts, nearest and latest."""
    top = m.bars.groupBy(*KEY).agg((F.max("idx") + 1).alias("_top"))
    cut = items.join(top, list(KEY)).withColumn("end", F.least(F.coalesce("end", "_top"), F.col("_top"))).withColumn("n", F.explode(_nodes(F.col("start"), F.col("end")))).select(*KEY, "kind", "id", "direction", "value", "event_timestamp", "confirmation_timestamp", "n.level", "n.node")
    when = F.struct("confirmation_timestamp", "event_timestamp", "id", "direction")
    aggs = [F.count_if(_is(*k)).alias(c) for c, k in COUNTS.items()] + [F.max(F.when(_is(*k), when)).alias(f"_{c}") for c, k in LATEST.items()]
    nodes = cut.groupBy(*KEY, "level", "node").agg(*aggs)
    bars = m.bars.select(*KEY, "idx", "close", F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.shiftright("idx", FAN_LOG2 * lv).alias("node")) for lv in range(3)])).alias("n")).select(*KEY, "idx", "close", "n.*")
    got = bars.join(nodes, [*KEY, "level", "node"], "left")
    out = got.groupBy(*KEY, "idx").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], *[F.max(f"_{c}").alias(f"_{c}") for c in LATEST]).join(_nearest(cut, bars), [*KEY, "idx"], "left")
    near = {}
    for c in NEAREST:
        name = c.removesuffix("_points")
        near |= {c: F.col(f"_{c}.distance") / point_of(), f"{name}_id": F.col(f"_{c}.id"), f"{name}_price": F.col(f"_{c}.price")}
    latest = {f"{c}_id": F.col(f"_{c}.id") for c in LATEST} | {f"{c}_direction_code": way_code(F.col(f"_{c}.direction")) for c, k in LATEST.items() if k[1] is None}
    return out.withColumns(near | latest).drop(*[f"_{c}" for c in (*NEAREST, *LATEST)])


def session_features(m: Market) -> DataFrame:
    """KEY, idx, active session names in order, and minutes since the first one's start."""
    w = m.windows
    b = m.bars.select(*KEY, "idx", F.col("close_time").alias("t"), F.explode(zones_of(m.session_defs)).alias("z")).select(*KEY, "idx", "t", "z.*")
    day = F.to_date(F.from_utc_timestamp("t", F.col("zone")))
    b = b.withColumn("local_date", F.explode(F.array(day, F.date_sub(day, 1)))).join(w, ["name", "zone", "local_date"]).filter("start_utc <= t AND t < end_utc")
    got = b.groupBy(*KEY, "idx", "t").agg(F.array_sort(F.collect_list(F.struct("name", "start_utc"))).alias("w"))
    elapsed = (F.unix_micros("t") - F.unix_micros(F.get("w", F.lit(0))["start_utc"])) / 60e6
    return got.select(*KEY, "idx", F.transform("w", lambda x: x["name"]).alias("active_sessions"), F.size("w").alias("active_session_count"), elapsed.alias("session_elapsed_minutes"), F.floor(elapsed).cast("int").alias("minute_of_session"))


def running(m: Market) -> DataFrame:
    """Bars with counts and latest of breaks, sweeps, CISD, daily opens and ranges."""
    breaks = m.breaks
    w = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = breaks.select(*KEY, F.col("confirmation_timestamp").alias("_bt"), F.col("event_type").alias("break_type"), F.col("direction").alias("break_direction"), F.col("reference_level").alias("break_level"), F.col("idx").alias("break_idx"), "break_id", "break_distance_points", *[F.count_if(F.col("event_type") == t).over(w).alias(f"{t}_count") for t in ("bos", "mss", "choch")], *[F.last(F.when(F.col("event_type") == t, F.col("break_id")), ignorenulls=True).over(w).alias(f"latest_{t}_id") for t in ("bos", "mss", "choch")])
    sw = m.sweeps.select(*KEY, F.col("confirmation_timestamp").alias("_st"), F.col("event_timestamp").alias("_se"), F.col("level_id").alias("sweep_level_id"), F.col("side").alias("sweep_side"), F.col("is_rejection").alias("sweep_is_rejection"), F.col("idx").alias("sweep_idx"))
    cd = m.cisd.select(*KEY, F.col("confirmation_timestamp").alias("_ct"), F.col("cisd_id"), F.col("direction").alias("delivery_state"), F.col("idx").alias("cisd_idx"))
    do = m.daily_opens.select(*KEY, F.col("confirmation_timestamp").alias("_dt"), F.col("price_level").alias("daily_open_price"), F.col("event_timestamp").alias("daily_open_timestamp"), F.col("trading_date").alias("daily_open_date"), F.col("level_id").alias("daily_open_id"))
    rg = m.ranges.select(*KEY, F.col("confirmation_timestamp").alias("_rt"), "range_id", F.col("direction").alias("range_direction"), "high_price", "low_price", "equilibrium_price", F.col("high_source_id").alias("high_anchor_id"), F.col("low_source_id").alias("low_anchor_id"), F.col("source_break_id").alias("range_break_id"))
    sides = [
        AsOf(seen, "_bt", ["break_type", "break_direction", "break_level", "break_idx", "break_id", "break_distance_points", "bos_count", "mss_count", "choch_count", "latest_bos_id", "latest_mss_id", "latest_choch_id"]),
        AsOf(sw, "_st", ["sweep_level_id", "sweep_side", "sweep_is_rejection", "sweep_idx"], [F.col("_se"), F.col("sweep_level_id")]),
        AsOf(cd, "_ct", ["cisd_id", "delivery_state", "cisd_idx"], [F.col("cisd_idx"), F.col("cisd_id")]),
        AsOf(do, "_dt", ["daily_open_price", "daily_open_timestamp", "daily_open_date", "daily_open_id"]),
        AsOf(rg, "_rt", ["range_id", "range_direction", "high_price", "low_price", "equilibrium_price", "high_anchor_id", "low_anchor_id", "range_break_id"], [F.col("range_id")]),
    ]
    return asof_joins(m.bars, "close_time", sides)


def states(m: Market) -> DataFrame:
    """One wide row per bar close: everything the feature vector needs, and the ids."""
    rows = kept(running(m), "running").join(alive_features(m, lifetimes(m)), [*KEY, "idx"]).join(session_features(m), [*KEY, "idx"], "left")
    today = F.to_date(F.from_utc_timestamp("close_time", NEW_YORK))
    return rows.withColumn("as_of", F.col("close_time")).withColumn("zone", zone_of(F.col("close"), F.col("equilibrium_price"), m.range_config.tolerance_points)).withColumn("is_current_trading_day", F.col("daily_open_date") == today)


def active_ids(m: Market) -> DataFrame:
    """KEY, idx, kind, direction and the sorted ids alive at that close. As large as what is
    alive, so apart from the vector."""
    top = m.bars.groupBy(*KEY).agg((F.max("idx") + 1).alias("_top"))
    rows = lifetimes(m).join(top, list(KEY)).withColumn("idx", F.explode(_span(F.col("start"), F.least(F.coalesce("end", "_top"), F.col("_top")))))
    return rows.groupBy(*KEY, "idx", "kind", "direction").agg(F.array_sort(F.collect_set("id")).alias("ids"))


# The columns of each context of a state, beside symbol, timeframe and as_of.
CONTEXTS = {
    "structure": ("break_id", "break_type", "break_direction", "break_level", "break_distance_points", "bars_since_break", "latest_bos_id", "latest_mss_id", "latest_choch_id", "bos_count", "mss_count", "choch_count"),
    "liquidity": ("buy_side_liquidity_count", "sell_side_liquidity_count", "nearest_buy_side_id", "nearest_buy_side_price", "nearest_buy_side_points", "nearest_sell_side_id", "nearest_sell_side_price", "nearest_sell_side_points", "sweep_level_id", "sweep_side", "sweep_is_rejection", "bars_since_sweep"),
    "imbalance": ("bullish_fvg_count", "bearish_fvg_count", "latest_bullish_fvg_id", "latest_bearish_fvg_id", "nearest_bullish_fvg_id", "nearest_bullish_fvg_price", "nearest_bullish_fvg_points", "nearest_bearish_fvg_id", "nearest_bearish_fvg_price", "nearest_bearish_fvg_points", "ifvg_count", "latest_ifvg_id", "bpr_count", "latest_bpr_id"),
    "institutional": ("bullish_order_block_count", "bearish_order_block_count", "latest_bullish_order_block_id", "latest_bearish_order_block_id", "bullish_breaker_count", "bearish_breaker_count", "latest_breaker_id", "latest_breaker_order_block_id"),
    "composites": ("rdrb_count", "latest_rdrb_id", "delivery_state", "cisd_id", "bars_since_cisd", "unicorn_count", "latest_unicorn_id", "latest_unicorn_fvg_id", "latest_unicorn_breaker_id", "latest_unicorn_order_block_id"),
    "daily_open": ("daily_open_id", "daily_open_date", "daily_open_price", "daily_open_timestamp", "is_current_trading_day"),
    "premium_discount": ("range_id", "high_anchor_id", "low_anchor_id", "range_break_id", "range_direction", "high_price", "low_price", "equilibrium_price", "zone"),
    "session": ("active_sessions", "active_session_count", "session_elapsed_minutes", "minute_of_session"),
}


def contexts(m: Market) -> DataFrame:
    """One row per bar close with a struct per context: what is latest, nearest and counted,
    with the ids it came from. Lists of ids are apart (active_ids, source_ids)."""
    s = states(m).withColumns({"bars_since_break": F.col("idx") - F.col("break_idx"), "bars_since_sweep": F.col("idx") - F.col("sweep_idx"), "bars_since_cisd": F.col("idx") - F.col("cisd_idx")})
    b = m.breakers.select(F.col("breaker_id").alias("latest_breaker_id"), F.col("source_order_block_id").alias("latest_breaker_order_block_id"))
    u = m.unicorns.select(F.col("unicorn_id").alias("latest_unicorn_id"), *[F.col(f"source_{c}_id").alias(f"latest_unicorn_{c}_id") for c in ("fvg", "breaker", "order_block")])
    s = s.join(b, "latest_breaker_id", "left").join(u, "latest_unicorn_id", "left")
    return s.select(*KEY, "as_of", "idx", "close", *[F.struct(*cols).alias(name) for name, cols in CONTEXTS.items()])


# The registry that each id of a state resolves in, and where the state has it.
SOURCES = {
    "structure": ("structure.break_id", "structure.latest_bos_id", "structure.latest_mss_id", "structure.latest_choch_id", "premium_discount.range_break_id"),
    "liquidity_level": ("liquidity.nearest_buy_side_id", "liquidity.nearest_sell_side_id", "liquidity.sweep_level_id"),
    "fvg": ("imbalance.latest_bullish_fvg_id", "imbalance.latest_bearish_fvg_id", "imbalance.nearest_bullish_fvg_id", "imbalance.nearest_bearish_fvg_id", "composites.latest_unicorn_fvg_id"),
    "ifvg": ("imbalance.latest_ifvg_id",), "bpr": ("imbalance.latest_bpr_id",),
    "order_block": ("institutional.latest_bullish_order_block_id", "institutional.latest_bearish_order_block_id", "institutional.latest_breaker_order_block_id", "composites.latest_unicorn_order_block_id"),
    "breaker": ("institutional.latest_breaker_id", "composites.latest_unicorn_breaker_id"),
    "rdrb": ("composites.latest_rdrb_id",), "cisd": ("composites.cisd_id",), "unicorn": ("composites.latest_unicorn_id",),
    "daily_open": ("daily_open.daily_open_id",), "dealing_range": ("premium_discount.range_id",), "swing": ("premium_discount.high_anchor_id", "premium_discount.low_anchor_id"),
}
GROUP_OF = {"level": "liquidity_level", "ob": "order_block"}


def state_at(m: Market, as_of) -> DataFrame:
    """contexts of the series that have a bar closing at that very instant; raises if none has."""
    at = contexts(m).filter(F.col("as_of") == F.lit(as_of).cast("timestamp"))
    if m.bars.filter(F.col("close_time") == F.lit(as_of).cast("timestamp")).isEmpty():
        raise ValueError(f"{as_of} is no bar close: a state is anchored to one")
    return at


def source_ids(m: Market, as_of) -> DataFrame:
    """KEY, group, id: every id that the states at one bar close name, of what is latest or
    nearest, alive, or swept by then."""
    at = kept(state_at(m, as_of), "state-at")
    named = [F.struct(F.lit(g).alias("group"), F.col(c).alias("id")) for g, cols in SOURCES.items() for c in cols]
    out = at.select(*KEY, F.explode(F.array(*named)).alias("s")).select(*KEY, "s.*")
    here = at.select(*KEY, F.col("idx").alias("_at"))
    group = F.coalesce(*[F.when(F.col("kind") == k, F.lit(g)) for k, g in GROUP_OF.items()], F.col("kind"))
    alive = lifetimes(m).join(here, list(KEY)).filter((F.col("start") <= F.col("_at")) & (F.col("end").isNull() | (F.col("_at") < F.col("end"))))
    swept = m.sweeps.join(here, list(KEY)).filter(F.col("idx") <= F.col("_at"))
    out = out.unionByName(alive.select(*KEY, group.alias("group"), "id")).unionByName(swept.select(*KEY, F.lit("liquidity_level").alias("group"), F.col("level_id").alias("id")))
    return out.filter("id IS NOT NULL").distinct()


def to_json(vectors: DataFrame) -> DataFrame:
    """Feature vectors as one JSON text a row, missing values as null, in the columns' order."""
    return vectors.select(F.to_json(F.struct(*vectors.columns), {"ignoreNullFields": "false"}).alias("value"))


def from_json(texts: DataFrame, schema) -> DataFrame:
    """The inverse of to_json, given the vectors' schema; a text that is none raises."""
    return texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")


def feature_vectors(m: Market) -> DataFrame:
    """symbol, timeframe, as_of, feature_version and the features in their order. A count of
    nothing is 0; a distance to nothing is null."""
    s = states(m)
    point = point_of()
    has_range = F.col("range_id").isNotNull()
    flag = lambda name: F.when(has_range, (F.col("zone") == name).cast("int"))
    structure = F.coalesce(F.col("break_direction"), F.lit("undefined"))
    delivery = F.coalesce(F.col("delivery_state"), F.lit("undefined"))
    votes = [(structure == BULL, structure == BEAR), (delivery == BULL, delivery == BEAR), (F.col("zone") == "discount", F.col("zone") == "premium"), (F.col("sweep_side") == "sell_side", F.col("sweep_side") == "buy_side")]
    count = lambda i: sum((F.coalesce(v[i], F.lit(False)).cast("int") for v in votes), F.lit(0))
    cols = {
        "distance_from_true_daily_open_points": (F.col("close") - F.col("daily_open_price")) / point,
        "distance_from_equilibrium_points": (F.col("close") - F.col("equilibrium_price")) / point,
        "percentage_position": F.try_divide(F.col("close") - F.col("low_price"), F.col("high_price") - F.col("low_price")),
        "is_premium": flag("premium"), "is_discount": flag("discount"), "is_equilibrium": flag("equilibrium"),
        "dealing_range_width_points": (F.col("high_price") - F.col("low_price")) / point,
        "dealing_range_direction_code": way_code("range_direction"),
        "structure_state_code": way_code(structure), "structure_direction_code": way_code(structure),
        "latest_break_type_code": F.when(F.col("break_type") == "bos", 1).when(F.col("break_type") == "mss", 2).when(F.col("break_type") == "choch", 3),
        "latest_break_direction_code": way_code("break_direction"),
        **{f"{t}_count": F.coalesce(f"{t}_count", F.lit(0)) for t in ("bos", "mss", "choch")},
        **{f"has_{t}": (F.coalesce(f"{t}_count", F.lit(0)) > 0).cast("int") for t in ("bos", "mss", "choch")},
        "bars_since_structural_break": F.col("idx") - F.col("break_idx"),
        "distance_from_structural_level_points": (F.col("close") - F.col("break_level")) / point,
        "has_recent_sweep": F.col("sweep_level_id").isNotNull().cast("int"),
        "latest_sweep_side_code": F.when(F.col("sweep_side") == "buy_side", -1).when(F.col("sweep_side") == "sell_side", 1),
        "latest_sweep_is_rejection": F.col("sweep_is_rejection").cast("int"),
        "bars_since_sweep": F.col("idx") - F.col("sweep_idx"),
        "has_cisd": F.col("cisd_id").isNotNull().cast("int"), "delivery_state_code": way_code(delivery), "bars_since_cisd": F.col("idx") - F.col("cisd_idx"),
        "trading_day_age_minutes": (F.unix_micros("close_time") - F.unix_micros("daily_open_timestamp")) / 60e6,
        "active_session_count": F.coalesce("active_session_count", F.lit(0)),
        "day_of_week": F.weekday("close_time"), "hour_of_day": F.hour("close_time"),
        "bullish_evidence_count": count(0), "bearish_evidence_count": count(1),
    }
    s = s.withColumns(cols)
    s = s.withColumn("bias_code", F.signum(F.col("bullish_evidence_count") - F.col("bearish_evidence_count")).cast("int"))
    return s.select(*KEY, "as_of", F.lit(FEATURE_VERSION).alias("feature_version"), *FEATURES)
