"""Registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import asof, audit, coverage, events, labels, splits
from tidemark.operators import bars as B
from tidemark.operators import blocks as K
from tidemark.operators import calendar as C
from tidemark.operators import gaps as G
from tidemark.operators import liquidity as L
from tidemark.operators import ranges as R
from tidemark.operators.asof import align_context
from tidemark.operators import swings as S
from tidemark.plans import dataset
from tidemark.plans.market import Market, event_bars, event_ticks
from tidemark.plans import state
from tidemark.plans.state import FEATURES, active_ids, feature_vectors, lifetimes
from tidemark.schema import Timeframe, with_close_time

H1, H4 = Timeframe("1h"), Timeframe("4h")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Results as the tables have them: timestamps without zone, integers as long."""
    df = df.select(*columns) if columns else df
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


def market(spark, sf_dir) -> Market:
    return Market(event_bars(spark, sf_dir, H1), H1)


Z = ("symbol", "direction", "top", "bottom", "event_timestamp", "confirmation_timestamp")


def ticks_to_bars(spark, sf_dir):
    return plain(event_bars(spark, sf_dir, H1), "symbol", "timestamp", "open", "high", "low", "close", "volume")


def resample_4h(spark, sf_dir):
    return plain(B.resample(event_bars(spark, sf_dir, H1), H1, H4), "symbol", "timestamp", "close_time", "open", "high", "low", "close", "volume")


def raw_candles(spark, sf_dir):
    """Dirty candles: every tick as a bar of its own, in supplied order."""
    t = event_ticks(spark, sf_dir)
    p = F.col("price")
    return t.select("symbol", "timestamp", p.alias("open"), (p + F.pmod("seq", F.lit(3)) - 0.5).alias("high"), (p - 0.25).alias("low"), p.alias("close"), F.lit(1.0).alias("volume"), "seq")


def normalize_bars(spark, sf_dir):
    return plain(B.normalize(raw_candles(spark, sf_dir), H1), "symbol", "timestamp", "open", "high", "low", "close", "volume")


def normalization_report(spark, sf_dir):
    return plain(B.normalization_report(raw_candles(spark, sf_dir), H1).drop("timeframe"))


def bar_gaps(spark, sf_dir):
    return plain(B.gaps(event_bars(spark, sf_dir, H1), H1).drop("timeframe"))


def asof_context(spark, sf_dir):
    base = with_close_time(event_bars(spark, sf_dir, H1), H1)
    out = align_context(base, B.resample(event_bars(spark, sf_dir, H1), H1, H4), H1, H4)
    return plain(out, "symbol", "timestamp", "close", "open_htf", "high_htf", "low_htf", "close_htf", "timestamp_htf")


def swing_points(spark, sf_dir):
    return plain(market(spark, sf_dir).swings, "symbol", "direction", "event_timestamp", "confirmation_timestamp", "price_level", "reference_level")


def swing_labels(spark, sf_dir):
    return plain(market(spark, sf_dir).labels, "symbol", "label", "direction", "event_timestamp", "confirmation_timestamp", "price_level", "reference_level", "previous_swing_timestamp")


BREAK = ("symbol", "event_type", "direction", "previous_state", "event_timestamp", "confirmation_timestamp", "price_level", "reference_level", "reference_swing_timestamp")


def structure_breaks(spark, sf_dir):
    return plain(market(spark, sf_dir).breaks, *BREAK)


def fvg_zones(spark, sf_dir):
    return plain(market(spark, sf_dir).fvg, *Z, "formation_timestamp", "zone_id")


def fvg_fills(spark, sf_dir):
    f = market(spark, sf_dir).fvg_fills.withColumn("fill_percentage", F.round("fill_percentage", 9))
    return plain(f, "symbol", "zone_id", "event_timestamp", "confirmation_timestamp", "fill_percentage", "deepest_price", "status_after")


def ifvg_zones(spark, sf_dir):
    return plain(market(spark, sf_dir).ifvg, "symbol", "direction", "top", "bottom", "source_fvg_id", "confirmation_timestamp", "trigger_close", "bars_to_invert")


def mitigated_without_inversion(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(G.mitigated_without_inversion(m.fvg_fills, m.ifvg), "symbol", "zone_id")


def bpr_zones(spark, sf_dir):
    return plain(market(spark, sf_dir).bpr, *Z, "bullish_fvg_id", "bearish_fvg_id", "bars_between")


def rdrb_zones(spark, sf_dir):
    return plain(market(spark, sf_dir).rdrb, *Z)


def order_blocks(spark, sf_dir):
    return plain(market(spark, sf_dir).blocks, *Z, "order_block_id", "break_bar_timestamp", "break_close", "bars_to_confirm", "related_fvg_id", "candle_count")


def order_block_status(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(K.block_status(m.blocks, K.zone_fills(m.blocks, m.bars, "order_block_id"), m.failures), "symbol", "order_block_id", "status", "failed_at")


def breaker_blocks(spark, sf_dir):
    return plain(market(spark, sf_dir).breakers, *Z, "source_order_block_id", "break_id", "failed_at", "failure_close")


def unicorns(spark, sf_dir):
    return plain(market(spark, sf_dir).unicorns, *Z, "source_breaker_id", "source_fvg_id", "fully_contained", "bars_between")


def cisd_transitions(spark, sf_dir):
    return plain(market(spark, sf_dir).cisd, "symbol", "direction", "previous_state", "event_timestamp", "confirmation_timestamp", "trigger_level", "trigger_close", "leg_start_timestamp", "leg_length")


def dealing_ranges(spark, sf_dir):
    return plain(market(spark, sf_dir).ranges, "symbol", "direction", "high_price", "low_price", "equilibrium_price", "high_source_id", "low_source_id", "event_timestamp", "confirmation_timestamp", "superseded_at")


def range_rejections(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(R.rejections(m.default_breaks, m.swings), "symbol", "range", "missing", "inverted", "unchanged")


def range_observations(spark, sf_dir):
    o = market(spark, sf_dir).observations.withColumn("percentage_position", F.round("percentage_position", 9))
    return plain(o, "symbol", "observation_timestamp", "range_id", "price", "zone", "percentage_position")


def session_occurrences(spark, sf_dir):
    return plain(market(spark, sf_dir).sessions, "symbol", "name", "local_date", "start_utc", "end_utc", "open_price", "high_price", "low_price", "close_price", "high_timestamp", "low_timestamp", "bar_count")


def period_levels(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(L.period_levels(m.days, m.weeks), "symbol", "level_id", "liquidity_type", "side", "price_level", "created_timestamp", "confirmation_timestamp")


def daily_opens(spark, sf_dir):
    return plain(market(spark, sf_dir).daily_opens, "symbol", "trading_date", "price_level", "event_timestamp", "level_id")


def equal_levels(spark, sf_dir):
    m = market(spark, sf_dir)
    # The instruments of the events table move by whole prices: a tolerance of 50 points.
    return plain(L.equal_levels(m.swings, L.LiquidityConfig(equal_tolerance_points=50.0)), "symbol", "level_id", "liquidity_type", "side", "price_level", "created_timestamp", "confirmation_timestamp")


def liquidity_levels(spark, sf_dir):
    return plain(market(spark, sf_dir).levels, "symbol", "level_id", "liquidity_type", "side", "price_level", "created_timestamp", "confirmation_timestamp")


def liquidity_sweeps(spark, sf_dir):
    return plain(market(spark, sf_dir).sweeps, "symbol", "level_id", "side", "event_timestamp", "confirmation_timestamp", "price_level", "extreme_price", "closed_beyond", "is_rejection")


def pending_references(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(S.pending_references(m.bars, m.swings, m.breaks), "symbol", "direction", "event_timestamp", "price_level")


def level_status(spark, sf_dir):
    """Levels as of an instant in the middle of the data, with approaches within 50 points."""
    m = market(spark, sf_dir)
    near = L.approaches(m.levels, m.bars, m.sweeps, 50.0)
    return plain(L.level_status(m.levels, m.sweeps, "2024-01-16 12:00:00", near), "symbol", "level_id", "status")


def item_lifetimes(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(lifetimes(m), "symbol", "kind", "id", "start", "end")


def active_id_counts(spark, sf_dir):
    rows = active_ids(market(spark, sf_dir))
    return plain(rows.groupBy("symbol", "idx", "kind").agg(F.sum(F.size("ids")).alias("n")))


def state_features(spark, sf_dir):
    v = feature_vectors(market(spark, sf_dir))
    return plain(v.select("symbol", "as_of", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURES]))


NAMED = tuple(f"structure.{c}" for c in ("break_id", "latest_bos_id", "latest_mss_id", "latest_choch_id")) + tuple(f"liquidity.{c}" for c in ("nearest_buy_side_id", "nearest_buy_side_price", "nearest_sell_side_id", "nearest_sell_side_price", "sweep_level_id")) + tuple(f"imbalance.{c}" for c in ("latest_bullish_fvg_id", "latest_bearish_fvg_id", "latest_ifvg_id", "latest_bpr_id"))
NAMED += tuple(f"institutional.{c}" for c in ("latest_bullish_order_block_id", "latest_bearish_order_block_id", "latest_breaker_id", "latest_breaker_order_block_id")) + tuple(f"composites.{c}" for c in ("latest_rdrb_id", "cisd_id", "latest_unicorn_id", "latest_unicorn_fvg_id", "latest_unicorn_breaker_id", "latest_unicorn_order_block_id"))
NAMED += ("daily_open.daily_open_id",) + tuple(f"premium_discount.{c}" for c in ("range_id", "high_anchor_id", "low_anchor_id", "range_break_id"))


def state_contexts(spark, sf_dir):
    """What every state names: the latest and nearest of each kind and their sources."""
    c = state.contexts(market(spark, sf_dir))
    near = [F.col(f"imbalance.nearest_{d}_fvg_{x}") for d in ("bullish", "bearish") for x in ("id", "price")]
    return plain(c.select("symbol", "as_of", *NAMED, *near, F.round("structure.break_distance_points", 6).alias("break_distance_points")))


def provenance_ids(spark, sf_dir):
    """Every id that the states at one bar close name."""
    return plain(state.source_ids(market(spark, sf_dir), "2024-01-16 12:00:00").drop("timeframe"))


def market_events(spark, sf_dir):
    m = market(spark, sf_dir)
    e = events.from_market(m, state.zone_ends(m)).withColumn("strength", F.round("strength", 6))
    return plain(e.drop("timeframe", "metadata"))


def zone_status_at(spark, sf_dir):
    """Every zone that is known at an instant in the middle of the data, with its status then."""
    return plain(state.zone_status(state.zone_ends(market(spark, sf_dir)), NOON), "symbol", "kind", "id", "status")


def unicorn_lifecycle(spark, sf_dir):
    return plain(state.unicorn_lifecycle(market(spark, sf_dir)).drop("timeframe"))


def provenance_faults(spark, sf_dir):
    """Ids of composites that name nothing, and composites known before their sources: none."""
    m = market(spark, sf_dir)
    lost = events.unresolved_provenance(m.unicorns, m.breakers.withColumnRenamed("breaker_id", "id"), ["source_breaker_id"])
    lost = lost.unionByName(events.unresolved_provenance(m.ifvg, m.fvg.withColumnRenamed("zone_id", "id"), ["source_fvg_id"]))
    early = events.confirmed_before_sources(m.unicorns, m.fvg, "source_fvg_id", "zone_id").select(F.col("unicorn_id").alias("id"))
    return lost.unionByName(early)


def planted_provenance_faults(spark, sf_dir):
    """The same checks where half the composites name a breaker that isn't there and all
    claim to be known an hour early."""
    m = market(spark, sf_dir)
    wrong = m.unicorns.withColumn("source_breaker_id", F.when(F.col("direction") == "bearish", F.concat("source_breaker_id", F.lit("?"))).otherwise(F.col("source_breaker_id")))
    lost = events.unresolved_provenance(wrong, m.breakers.withColumnRenamed("breaker_id", "id"), ["source_breaker_id"]).select(F.lit("lost").alias("fault"), "id")
    hasty = m.unicorns.withColumn("confirmation_timestamp", F.expr("confirmation_timestamp - INTERVAL '1' HOUR"))
    early = events.confirmed_before_sources(hasty, m.fvg, "source_fvg_id", "zone_id").select(F.lit("early").alias("fault"), F.col("unicorn_id").alias("id"))
    return plain(lost.unionByName(early))


TARGETS = [labels.Target("ret_4", "future_return", 4), labels.Target("dir_4", "direction", 4, threshold_points=2000.0), labels.Target("exc_4", "excursion", 4), labels.Target("tpsl_8", "tp_before_sl", 8, side="long", take_profit_points=3000.0, stop_loss_points=3000.0), labels.Target("short_8", "tp_before_sl", 8, side="short", take_profit_points=2000.0, stop_loss_points=2500.0)]


def targets(spark, sf_dir):
    v = labels.all_targets(market(spark, sf_dir).bars, TARGETS)
    return plain(v.withColumn("future_return", F.round("future_return", 9)), "symbol", "as_of", "spec_name", "resolved", "unresolved_reason", "future_return", "future_move_points", "direction", "up_excursion_points", "down_excursion_points", "outcome", "resolving_bar_timestamp", "future_window_end")


def split_labels(spark, sf_dir):
    v = labels.target_values(market(spark, sf_dir).bars, TARGETS[3]).withColumnRenamed("future_window_end", "window_end")
    return plain(splits.assign(v, splits.by_proportion(v), 8), "symbol", "as_of", "natural_label", "label")


def split_summary(spark, sf_dir):
    v = labels.target_values(market(spark, sf_dir).bars, TARGETS[3]).withColumnRenamed("future_window_end", "window_end")
    return plain(splits.summary(splits.assign(v, splits.by_proportion(v), 8)).drop("timeframe"))


def target_diagnostics(spark, sf_dir):
    d = audit.target_diagnostics(labels.all_targets(market(spark, sf_dir).bars, TARGETS))
    return plain(d.select("spec_name", "total", "resolved_count", "unresolved_count", F.to_json("class_counts").alias("classes"), F.to_json("unresolved_by_reason").alias("reasons")))


def _dataset(spark, sf_dir):
    return dataset.build(market(spark, sf_dir), dataset.DatasetSpec(tuple(TARGETS)))


def dataset_rows(spark, sf_dir):
    rows = dataset.flat(_dataset(spark, sf_dir), "dir_4").drop("timeframe")
    return plain(rows.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in FEATURES} | {"target_future_return": F.round("target_future_return", 9)}))


def dataset_audit(spark, sf_dir):
    return plain(audit.dataset_audit(_dataset(spark, sf_dir)).drop("timeframe"))


def feature_diagnostics(spark, sf_dir):
    v = feature_vectors(market(spark, sf_dir))
    d = audit.feature_diagnostics(v.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURES]), list(FEATURES))
    return plain(d.withColumn("mean", F.round("mean", 4)))


def session_profile(spark, sf_dir):
    return plain(coverage.session_profile(event_bars(spark, sf_dir, H1), H1))


def coverage_4h(spark, sf_dir):
    return plain(coverage.coverage(event_bars(spark, sf_dir, H1), H1, H4).drop("coverage_ratio"))


def coverage_summary(spark, sf_dir):
    return plain(coverage.coverage_summary(coverage.coverage(event_bars(spark, sf_dir, H1), H1, H4)))


def h4_windows(spark, sf_dir):
    return plain(coverage.build_h4(event_bars(spark, sf_dir, H1)))


def h4_counts(spark, sf_dir):
    return plain(coverage.h4_counts(coverage.build_h4(event_bars(spark, sf_dir, H1))))


def market_week(spark, sf_dir):
    """Bars of a market that shuts at weekends and for two hours every day."""
    open_ = (F.weekday("timestamp") < 5) & ~F.hour("timestamp").isin(21, 22)
    return event_bars(spark, sf_dir, H1).filter(open_)


def week_profile(spark, sf_dir):
    return plain(coverage.session_profile(market_week(spark, sf_dir), H1))


def week_coverage_4h(spark, sf_dir):
    return plain(coverage.coverage(market_week(spark, sf_dir), H1, H4).drop("coverage_ratio"))


def week_coverage_summary(spark, sf_dir):
    return plain(coverage.coverage_summary(coverage.coverage(market_week(spark, sf_dir), H1, H4)))


def week_h4_windows(spark, sf_dir):
    return plain(coverage.build_h4(market_week(spark, sf_dir)))


def quotes(spark, sf_dir):
    """Events as quotes, some of them faulty."""
    t, k = event_ticks(spark, sf_dir), F.pmod("seq", F.lit(7))
    hour = F.date_trunc("hour", "timestamp")
    bid = F.when(k == 1, F.lit(None)).when(k == 2, -F.col("price")).otherwise(F.floor("price"))
    return t.select("symbol", hour.alias("timestamp"), bid.cast("double").alias("bid"), (F.floor("price") + F.when(k == 3, -1).otherwise(1)).cast("double").alias("ask"), F.when(k == 4, -1.0).otherwise(1.0).alias("bid_volume"), F.lit(1.0).alias("ask_volume"), "seq")


def tick_report(spark, sf_dir):
    return plain(B.tick_report(quotes(spark, sf_dir)))


def clean_quotes(spark, sf_dir):
    return plain(B.clean_ticks(quotes(spark, sf_dir)), "symbol", "timestamp", "bid", "ask", "seq")


NOON = "2024-01-16 12:30:00"


def latest_closed_bars(spark, sf_dir):
    return plain(asof.latest_closed_bar(market(spark, sf_dir).bars, NOON), "symbol", "timestamp", "close_time", "close")


def observable_swings(spark, sf_dir):
    return plain(asof.observable(market(spark, sf_dir).swings, NOON), "symbol", "direction", "event_timestamp", "confirmation_timestamp")


def session_states(spark, sf_dir):
    m = market(spark, sf_dir)
    rows = C.session_state(m.bars, m.windows, NOON).withColumn("position_in_range", F.round("position_in_range", 9))
    return plain(rows, "symbol", "name", "start_utc", "high_price", "low_price", "bar_count", "is_active", "is_complete", "position_in_range")


def pending_periods(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(L.pending_periods(m.days, m.weeks), "symbol", "period", "label", "high_price", "low_price")


def failed_without_structure(spark, sf_dir):
    m = market(spark, sf_dir)
    return plain(K.failed_without_structure(m.failures, m.breakers), "symbol", "order_block_id", "failed_at")


def weekday_occurrences(spark, sf_dir):
    return plain(coverage.weekday_occurrences(event_bars(spark, sf_dir, H1), H1))


def merged_tick_reports(spark, sf_dir):
    q = quotes(spark, sf_dir)
    parts = [B.tick_report(q.filter(F.pmod("seq", F.lit(2)) == i)) for i in (0, 1)]
    return plain(B.merge_tick_reports(parts[0].unionByName(parts[1])), "symbol", "total", "missing", "nonpositive", "crossed", "negative_volume", "max_spread")


QUERIES = {
    f.__name__: f
    for f in (
        ticks_to_bars, resample_4h, normalize_bars, normalization_report, bar_gaps, asof_context, swing_points, swing_labels, structure_breaks, fvg_zones, fvg_fills, ifvg_zones, mitigated_without_inversion, bpr_zones, rdrb_zones,
        order_blocks, order_block_status, breaker_blocks, unicorns, cisd_transitions, dealing_ranges, range_rejections, range_observations, session_occurrences, period_levels, daily_opens, equal_levels, liquidity_levels, liquidity_sweeps,
        pending_references, level_status, item_lifetimes, active_id_counts, state_features, state_contexts, provenance_ids, market_events, zone_status_at, unicorn_lifecycle, provenance_faults, planted_provenance_faults, targets, split_labels, split_summary, target_diagnostics, dataset_rows, dataset_audit, feature_diagnostics,
        session_profile, coverage_4h, coverage_summary, h4_windows, h4_counts, week_profile, week_coverage_4h, week_coverage_summary, week_h4_windows, tick_report, clean_quotes,
        latest_closed_bars, observable_swings, session_states, pending_periods, failed_without_structure, weekday_occurrences, merged_tick_reports,
    )
}
