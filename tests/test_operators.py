from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, blocks, calendar, coverage, gaps, labels, liquidity, ranges, search, splits, swings
from tidemark.operators import bars as B
from tidemark.plans.market import Market
from tidemark.schema import CANDLE, Timeframe, prepared

M5, H1 = Timeframe("5m"), Timeframe("1h")
START = datetime(2024, 3, 8, 9, tzinfo=UTC)


def frame(spark, rows, tf=M5, start=START, symbol="EURUSD", skip=()):
    """Bars from (open, high, low, close) or (high, low)."""
    out, t = [], start
    for i, r in enumerate(rows):
        o, h, lo, c = r if len(r) == 4 else ((r[0] + r[1]) / 2, r[0], r[1], (r[0] + r[1]) / 2)
        if i not in skip:
            out.append((t, symbol, tf.name, float(o), float(h), float(lo), float(c), 10.0 * (i + 1)))
        t += timedelta(minutes=tf.minutes)
    return spark.createDataFrame(out, CANDLE)


def walk(spark, n, seed=0, tf=M5, digits=3, symbol="EURUSD"):
    rng = np.random.default_rng(seed)
    rows, p = [], 1.1
    for _ in range(n):
        c = round(p + rng.normal() * 0.004, digits)
        h, lo = max(p, c) + abs(rng.normal()) * 0.002, min(p, c) - abs(rng.normal()) * 0.002
        rows.append((p, max(round(h, digits), p, c), min(round(lo, digits), p, c), c))
        p = c
    return frame(spark, rows, tf, symbol=symbol)


def test_fvg_by_hand(spark):
    up = frame(spark, [(1.01, 1.0), (1.03, 1.005), (1.04, 1.02)])
    z = gaps.fvg_zones(prepared(up, M5)).collect()
    assert [(r["direction"], r["bottom"], r["top"]) for r in z] == [("bullish", 1.01, 1.02)] and z[0]["confirmation_timestamp"].minute == 15
    down = frame(spark, [(1.04, 1.03), (1.035, 1.01), (1.02, 1.0)])
    assert [(r["bottom"], r["top"]) for r in gaps.fvg_zones(prepared(down, M5)).collect()] == [(1.02, 1.03)]
    apart = frame(spark, [(1.01, 1.0), (1.02, 1.0), (1.03, 1.005), (1.04, 1.021)], skip=(1,))
    assert gaps.fvg_zones(prepared(apart, M5)).count() == 0


def test_swings_and_labels_by_hand(spark):
    hl = [(1.02, 0.99), (1.05, 1.0), (1.03, 0.98), (1.02, 0.95), (1.04, 0.99), (1.07, 1.01), (1.05, 1.0), (1.04, 0.97), (1.06, 1.0)]
    s = swings.swings(prepared(frame(spark, hl), M5), swings.SwingConfig(1, 1))
    got = {(r["label"], r["event_timestamp"].minute // 5) for r in swings.swing_labels(s).collect()}
    assert got == {("higher_high", 5), ("higher_low", 7)}


@pytest.mark.parametrize("policy", swings.TIE_POLICIES)
def test_swings_against_plain_code(spark, policy):
    b = walk(spark, 120, 3, digits=2)
    rows = b.orderBy("timestamp").collect()
    want = set()
    for i in range(3, len(rows) - 2):
        for kind, key, sign in (("bullish", "high", 1), ("bearish", "low", -1)):
            v = [sign * r[key] for r in rows]
            before, after = max(v[i - 3 : i]), max(v[i + 1 : i + 3])
            a = v[i] >= before if policy in ("last", "all") else v[i] > before
            z = v[i] >= after if policy in ("first", "all") else v[i] > after
            if a and z:
                want.add((kind, i))
    got = {(r["direction"], r["idx"]) for r in swings.swings(prepared(b, M5), swings.SwingConfig(3, 2, policy)).collect()}
    assert got == want


def test_breaks_against_a_state_machine(spark):
    for seed, mode in ((1, "close"), (2, "wick")):
        b = prepared(walk(spark, 150, seed), M5)
        s = swings.swings(b)
        conf = swings.StructureConfig(break_mode=mode)
        got = [(r["idx"], r["direction"], r["event_type"] == "bos") for r in swings.structure_breaks(b, s, conf).orderBy("idx").collect()]
        bars, todo = b.orderBy("idx").collect(), sorted(s.collect(), key=lambda r: (r["confirmation_timestamp"], r["event_timestamp"], r["direction"]))
        hi = lo = None
        state, want = None, []
        for r in bars:
            while todo and todo[0]["confirmation_timestamp"] <= r["close_time"]:
                x = todo.pop(0)
                hi, lo = (x["price_level"], lo) if x["direction"] == "bullish" else (hi, x["price_level"])
            up, down = (r["close"], r["close"]) if mode == "close" else (r["high"], r["low"])
            if hi is not None and up > hi:
                want.append((r["idx"], "bullish", state in (None, "bullish")))
                state, hi = "bullish", None
            elif lo is not None and down < lo:
                want.append((r["idx"], "bearish", state in (None, "bearish")))
                state, lo = "bearish", None
        assert got == want and want


def test_first_hit_climbs_and_descends(spark, monkeypatch):
    b = prepared(walk(spark, 700, 5), M5)
    v = [r["close"] for r in b.orderBy("idx").collect()]
    items = spark.createDataFrame([("EURUSD", "5m", i, s, v[s] + d) for i, (s, d) in enumerate((s, d) for s in range(0, 700, 9) for d in (0.0, 0.01, 0.1))], "symbol string, timeframe string, k int, start long, level double")
    for above, inclusive in ((True, False), (False, True)):
        got = {r["k"]: r["hit_idx"] for r in search.first_hit(items, b, F.col("close"), above, "start", "level", inclusive).collect()}
        for r in items.collect():
            ok = (lambda x: x > r["level"]) if above else (lambda x: x <= r["level"])  # noqa: B023
            assert got[r["k"]] == next((i for i in range(r["start"], 700) if ok(v[i])), None)


@pytest.mark.parametrize(("levels", "n"), [(1, 300), (2, 40_000)])
def test_first_hit_beyond_the_first_top_node(spark, monkeypatch, levels, n):
    monkeypatch.setattr(search, "LEVELS", levels)
    bars = spark.range(n).select(F.lit("X").alias("symbol"), F.lit("5m").alias("timeframe"), F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("close"))
    items = spark.createDataFrame([("X", "5m", 3, n - 2.5), ("X", "5m", 3, 5.5), ("X", "5m", n - 1, 1.0), ("X", "5m", 3, n + 1.0)], "symbol string, timeframe string, start int, level double")
    got = {(r["start"], r["level"]): r["hit_idx"] for r in search.first_hit(items, bars, F.col("close"), True, "start", "level").collect()}
    assert got == {(3, n - 2.5): n - 2, (3, 5.5): 6, (n - 1, 1.0): n - 1, (3, n + 1.0): None}


@pytest.mark.parametrize("partial,full", [(0.0, 1.0), (0.25, 0.75)])
def test_fill_stream_against_a_loop(spark, partial, full):
    b = prepared(walk(spark, 400, 8), M5)
    z = gaps.fvg_zones(b)
    got = {}
    for r in gaps.fvg_fills(z, b, gaps.FvgConfig(partial_fill_threshold=partial, full_fill_threshold=full)).collect():
        got.setdefault(r["zone_id"], []).append((r["idx"], round(r["fill_percentage"], 9), r["status_after"]))
    bars, want = b.orderBy("idx").collect(), {}
    for r in z.collect():
        best, ext = 0.0, None
        for x in bars[r["idx"] + 1 :]:
            bull = r["direction"] == "bullish"
            c = x["low"] if bull else x["high"]
            ext = c if ext is None else min(ext, c) if bull else max(ext, c)
            f = (r["top"] - ext) / (r["top"] - r["bottom"]) if bull else (ext - r["bottom"]) / (r["top"] - r["bottom"])
            f = min(max(f, 0.0), 1.0)
            if f <= best:
                continue
            best = f
            if f < full and f <= partial:
                continue
            want.setdefault(r["zone_id"], []).append((x["idx"], round(f, 9), "mitigated" if f >= full else "partially_filled"))
            if f >= full:
                break
    assert {k: sorted(v) for k, v in got.items()} == want and want


def test_order_block_and_breaker_by_hand(spark):
    rows = [(1.005, 1.0055, 1.0045, 1.005), (1.0052, 1.006, 1.003, 1.0035), (1.0035, 1.0075, 1.0034, 1.007), (1.007, 1.0072, 1.0055, 1.0058), (1.0058, 1.0059, 1.002, 1.0025), (1.0025, 1.004, 1.0018, 1.0022)]
    b = prepared(frame(spark, rows), M5)
    z = gaps.fvg_zones(b)
    ob = blocks.order_blocks(b, z).filter("direction = 'bullish'")
    assert [(r["bottom"], r["top"], r["bars_to_confirm"]) for r in ob.collect()] == [(1.003, 1.006, 1)]
    br = blocks.breakers(ob, blocks.failures(ob, b), None, b, require_structure=False)
    assert [(r["direction"], r["event_timestamp"].minute) for r in br.collect()] == [("bearish", 20)]
    un = blocks.unicorns(br, z, M5).collect()
    assert [(round(r["bottom"], 4), round(r["top"], 4)) for r in un] == [(1.004, 1.0055)]


def test_rdrb_cisd_bpr_by_hand(spark):
    r4 = [(1.0, 1.002, 0.999, 1.0015), (1.0015, 1.004, 1.0005, 1.0035), (1.0035, 1.005, 1.003, 1.0045), (1.0045, 1.007, 1.004, 1.0065)]
    assert [(r["bottom"], r["top"]) for r in gaps.rdrb(prepared(frame(spark, r4), M5)).collect()] == [(1.0005, 1.004)]
    c4 = [(1.01, 1.0105, 1.008, 1.0085), (1.0085, 1.009, 1.006, 1.0065), (1.0065, 1.007, 1.004, 1.0045), (1.0045, 1.012, 1.0044, 1.0115)]
    assert [(r["direction"], r["trigger_level"], r["trigger_close"]) for r in blocks.cisd(prepared(frame(spark, c4), M5)).collect()] == [("bullish", 1.01, 1.0115)]
    p6 = [(1.002, 1.005, 1.001, 1.0045), (1.0045, 1.011, 1.004, 1.0105), (1.0105, 1.013, 1.01, 1.0125), (1.0125, 1.014, 1.0105, 1.0135), (1.0135, 1.0138, 1.006, 1.0065), (1.0065, 1.007, 1.003, 1.0035)]
    assert [(r["bottom"], r["top"]) for r in gaps.bpr(gaps.fvg_zones(prepared(frame(spark, p6), M5)), M5).collect()] == [(1.007, 1.01)]


def test_prefixes_agree_with_the_whole(spark):
    """What a prefix of the bars yields is what of the whole was observable by its end."""
    raw = walk(spark, 160, 12)
    whole = Market(raw, M5, require_structure=False)
    for n in (60, 110):
        end = START + timedelta(minutes=5 * n)
        part = Market(raw.filter(F.col("timestamp") < F.lit(end)), M5, require_structure=False)
        for name, key in (("swings", "swing_id"), ("breaks", "break_id"), ("fvg", "zone_id"), ("ifvg", "ifvg_id"), ("blocks", "order_block_id"), ("breakers", "breaker_id"), ("cisd", "cisd_id"), ("ranges", "range_id"), ("sweeps", "level_id")):
            a = {r[0] for r in asof.observable(getattr(whole, name), end).select(key).collect()}
            b = {r[0] for r in getattr(part, name).select(key).collect()}
            assert a == b, name
            assert asof.leaks(getattr(whole, name)).count() == 0


def test_small_blocks_and_cells_change_nothing(spark, monkeypatch):
    """Windows cut into blocks and as-of joins cut into cells see what whole series show."""
    from tidemark import schema
    from tidemark.plans.state import feature_vectors

    def all_of(raw):
        m = Market(raw, M5, require_structure=False)
        race = labels.Target("x", "tp_before_sl", 7, side="long", take_profit_points=100, stop_loss_points=100)
        frames = {n: getattr(m, n) for n in ("bars", "swings", "labels", "breaks", "fvg", "rdrb", "blocks", "failures", "cisd", "ranges", "sweeps", "observations")} | {"targets": labels.target_values(m.bars, race), "vectors": feature_vectors(m)}
        return {n: sorted(map(repr, df.collect())) for n, df in frames.items()}

    raw = walk(spark, 150, 5).unionByName(frame(spark, [(1.0, 1.1, 0.9, 1.05)] * 40, symbol="B", skip=range(9, 30)))
    whole = all_of(raw)
    monkeypatch.setattr(schema, "BLOCK_LOG2", 2)
    monkeypatch.setattr(asof, "CELL_SECONDS", 1500)
    cut = all_of(raw)
    assert all(whole["vectors"]) and len(whole["bars"]) == 169
    for name in whole:
        assert whole[name] == cut[name], name


def test_daylight_saving(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-06-01 12:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in df.select(calendar.dst_anomaly(F.col("t"), "America/New_York")).collect()] == ["nonexistent", "ambiguous", "none"]
    rows = [(1.0, 1.001, 0.999, 1.0)] * 24 * 4
    b = prepared(frame(spark, rows, H1, datetime(2024, 3, 9, tzinfo=UTC)), H1)
    opens = {str(r["trading_date"]): r["event_timestamp"].hour for r in calendar.daily_opens(b).collect()}
    assert opens == {"2024-03-09": 5, "2024-03-10": 5, "2024-03-11": 4, "2024-03-12": 4}
    w = calendar.windows(spark, calendar.span_of(b)).filter("name = 'new_york' AND local_date = '2024-03-11'").first()
    assert (w["start_utc"].hour, w["end_utc"].hour) == (12, 21)
    with pytest.raises(ValueError):
        calendar.session_definitions('[{"name": "x"}]')


def test_normalise_keeps_the_last_then_drops_what_is_invalid(spark):
    t = START
    rows = [(t, 1.0, 1.1, 0.9, 1.0, 1.0, 1), (t, 1.0, 0.5, 0.9, 1.0, 1.0, 2), (t + timedelta(minutes=7), 1.0, 1.1, 0.9, 1.0, 1.0, 3), (t + timedelta(minutes=30), 1.0, 1.1, 0.9, float("nan"), 1.0, 4)]
    raw = spark.createDataFrame(rows, "timestamp timestamp, open double, high double, low double, close double, volume double, seq long")
    got = B.normalize(raw, M5, symbol="EURUSD").collect()
    assert [r["timestamp"].minute for r in got] == [5]
    with pytest.raises(ValueError, match="order"):
        B.normalize(raw.drop("seq"), M5)
    with pytest.raises(ValueError):
        B.resample(raw, H1, M5)


def test_coverage_and_profile(spark):
    rows = [(1.0, 1.001, 0.999, 1.0)] * 24 * 16
    shut = {d * 24 + h for d in range(16) for h in (22, 23)}
    b = frame(spark, rows, H1, datetime(2024, 1, 1, tzinfo=UTC), skip=shut | {30})
    assert {r["minute"] for r in coverage.session_profile(b, H1).collect()} == {22 * 60, 23 * 60}
    got = {(r["timestamp"].day, r["timestamp"].hour): (r["cause"], r["longest_missing_run"]) for r in coverage.coverage(b, H1, Timeframe("4h")).collect()}
    assert got[1, 20] == ("market_closed", 2) and got[2, 4] == ("undetermined", 1) and got[1, 0] == ("none", 0)
    c = coverage.h4_counts(coverage.build_h4(b)).first()
    assert c["withheld_undetermined"] == 1 and c["windows"] == sum(c[d] for d in coverage.DISPOSITIONS)


def test_targets_and_their_rules(spark):
    b = prepared(frame(spark, [(1.0, 1.0, 1.0, 1.0), (1.0, 1.001, 0.9995, 1.0005), (1.0005, 1.003, 0.998, 1.0), (1.0, 1.0, 1.0, 1.0)]), M5)
    one = lambda t, i: labels.target_values(b, t).orderBy("as_of").collect()[i]
    race = labels.Target("x", "tp_before_sl", 2, side="long", take_profit_points=100, stop_loss_points=500)
    assert one(race, 0)["outcome"] == "tp_first" and one(labels.Target("x", "tp_before_sl", 2, side="long", take_profit_points=200, stop_loss_points=100), 1)["unresolved_reason"] == "same_bar_ambiguity"
    assert one(race, 3)["unresolved_reason"] == "insufficient_history"
    assert one(labels.Target("x", "direction", 1, threshold_points=50.0), 0)["direction"] == "up"
    assert one(labels.Target("x", "excursion", 2), 0)["down_excursion_points"] == 200.0
    for bad in (dict(kind="direction", horizon=1), dict(kind="excursion", horizon=0), dict(kind="tp_before_sl", horizon=1, side="long"), dict(kind="future_return", horizon=1, side="long")):
        with pytest.raises(labels.TargetError):
            labels.Target("x", **bad)


def test_embargo(spark):
    rows = spark.createDataFrame([("EURUSD", "5m", START + timedelta(minutes=5 * i), START + timedelta(minutes=5 * (i + 2)) if i < 8 else None) for i in range(10)], "symbol string, timeframe string, as_of timestamp, window_end timestamp")
    got = [r["label"] for r in splits.assign(rows, splits.by_proportion(rows, 0.5, 0.3), 2).orderBy("as_of").collect()]
    assert got == ["train"] * 3 + ["embargoed"] * 2 + ["validation"] + ["embargoed"] * 2 + ["test"] * 2
    with pytest.raises(splits.SplitError):
        splits.by_proportion(rows, 0.9, 0.2)


def test_sweeps_may_come_with_the_confirming_bar(spark):
    b = prepared(walk(spark, 120, 21), M5)
    lv = liquidity.swing_levels(swings.swings(b))
    got = {r["level_id"]: r["idx"] for r in liquidity.sweeps(lv, b).collect()}
    bars = b.orderBy("idx").collect()
    for r in lv.collect():
        hit = next((x["idx"] for x in bars if x["close_time"] >= r["confirmation_timestamp"] and (x["high"] > r["price_level"] if r["side"] == "buy_side" else x["low"] < r["price_level"])), None)
        assert got.get(r["level_id"]) == hit


def test_no_nested_loop_joins(spark):
    m = Market(walk(spark, 60, 2), M5)
    for df in (m.breaks, asof.asof_join(m.bars, m.fvg, "close_time", "confirmation_timestamp", ["zone_id"]), liquidity.sweeps(m.levels, m.bars), ranges.observations(m.bars, m.ranges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_view_of_a_market_has_a_nested_loop(spark):
    from functools import cached_property

    from tidemark.operators import events
    from tidemark.plans import state

    m = Market(walk(spark, 60, 2), M5)
    names = [n for n, v in vars(Market).items() if isinstance(v, cached_property)]
    assert len(names) > 20
    frames = {n: getattr(m, n) for n in names} | {"state": state.states(m), "events": events.from_market(m, state.zone_ends(m)), "unicorns": state.unicorn_lifecycle(m)}
    frames |= {"windows": calendar.windows(spark, calendar.span_of(m.bars)), "members": calendar.members(m.bars, m.windows), "now": calendar.session_state(m.bars, m.windows, START + timedelta(hours=2))}
    for name, df in frames.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        # One row of extent meets a handful of definitions: no other join is without keys.
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_unreadable_timestamps_are_dropped_and_counted(spark):
    from tidemark.operators import bars as B

    rows = [("junk", 1.0, 0), (None, 2.0, 1), ("2024-03-08 09:01:00", 3.0, 2), ("2024-03-08 09:02:00", 4.0, 3), ("2024-03-08 09:07:00", 5.0, 4), ("??", 6.0, 5)]
    raw = spark.createDataFrame([(t, p, p, p, p, 1.0, s, "EURUSD") for t, p, s in rows], "timestamp string, open double, high double, low double, close double, volume double, seq int, symbol string")
    got = B.normalize(raw, M5).orderBy("timestamp").collect()
    assert [(r["timestamp"].minute, r["close"]) for r in got] == [(0, 4.0), (5, 5.0)]
    r = B.normalization_report(raw, M5).first()
    assert (r["rows_in"], r["rows_out"], r["duplicates"], r["invalid"]) == (6, 2, 1, 3)


def test_search_with_small_nodes(spark, monkeypatch):
    monkeypatch.setattr(search, "FAN_LOG2", 2)
    test_first_hit_climbs_and_descends(spark, monkeypatch)
    test_fill_stream_against_a_loop(spark, 0.0, 1.0)


def test_dataset_audit_sees_rows_out_of_order(spark):
    from tidemark.operators import audit

    rows = spark.createDataFrame([("A", "5m", START + timedelta(minutes=i), s, "train") for s, i in enumerate((0, 5, 3))], "symbol string, timeframe string, as_of timestamp, seq int, label string")
    assert not audit.dataset_audit(rows, seq="seq").first()["chronological"] and audit.dataset_audit(rows).first()["chronological"]


def test_nearest_against_a_scan(spark):
    """The nearest of several alive items, ties by id, for bars in nodes of every level."""
    from tidemark.plans import state

    m = Market(walk(spark, 200, 8, digits=2), M5)
    items = [(r["direction"], r["value"], r["id"], r["start"], r["end"]) for r in state.lifetimes(m).filter("kind = 'level'").collect()]
    rows = state.alive_features(m, state.lifetimes(m)).join(m.bars.select("symbol", "timeframe", "idx", "close"), ["symbol", "timeframe", "idx"]).collect()
    assert len(rows) == 200 and len({i[1] for i in items}) < len(items)
    for r in rows:
        for side in ("buy_side", "sell_side"):
            best = min(((abs(v - r["close"]), i, v) for d, v, i, a, b in items if d == side and a <= r["idx"] and (b is None or r["idx"] < b)), default=(None,) * 3)
            assert (r[f"nearest_{side}_id"], r[f"nearest_{side}_price"]) == best[1:]


def test_states_and_targets_are_anchored_to_a_close(spark):
    from tidemark.plans import state

    m = Market(walk(spark, 60, 2), M5)
    at, between = START + timedelta(minutes=5 * 40), START + timedelta(minutes=5 * 40 + 2)
    spec = labels.Target("x", "excursion", 6)
    assert [r.asDict() for r in labels.value_at(m.bars, spec, at).collect()] == [r.asDict() for r in labels.target_values(m.bars, spec).filter(F.col("as_of") == F.lit(at)).collect()]
    row = state.state_at(m, at).first()
    assert row["idx"] == 39 and set(state.CONTEXTS) <= set(row.asDict())
    for look in (lambda: labels.value_at(m.bars, spec, between), lambda: state.state_at(m, between)):
        with pytest.raises(ValueError):
            look()


def test_vectors_survive_their_texts(spark):
    from tidemark.plans import state

    v = state.feature_vectors(Market(walk(spark, 60, 2), M5))
    v = spark.createDataFrame(v.collect(), v.schema)
    back = state.from_json(state.to_json(v), v.schema)
    assert back.columns == v.columns and sorted(map(repr, back.collect())) == sorted(map(repr, v.collect()))


def test_every_detector_is_configured_from_one_place(spark):
    raw = walk(spark, 200, 12)
    base = Market(raw, M5, require_structure=False)
    loose = Market(
        raw, M5, require_structure=False, ifvg_config=gaps.IfvgConfig("wick_through", 40), bpr_config=gaps.BprConfig(polarity="neutral"), rdrb_config=gaps.RdrbConfig(require_directional_c1=False, require_directional_c4=False), breaker_config=blocks.BreakerConfig(wick=True),
        cisd_config=blocks.CisdConfig(anchor="extreme_open", min_leg=2), unicorn_config=blocks.UnicornConfig(3), range_config=ranges.RangeConfig(1e6),
    )
    assert loose.rdrb.count() > base.rdrb.count() and loose.rdrb.join(base.rdrb, "rdrb_id").count() == base.rdrb.count()
    assert loose.failures.count() >= base.failures.count() and loose.ifvg.agg(F.max("bars_to_invert")).first()[0] <= 40
    assert {r[0] for r in loose.bpr.select("direction").distinct().collect()} == {"neutral"} and loose.unicorns.agg(F.max("bars_between")).first()[0] <= 3
    assert loose.cisd.agg(F.min("leg_length")).first()[0] >= 2 and {r[0] for r in loose.observations.select("zone").distinct().collect()} <= {"equilibrium"}
    for make in (lambda: gaps.IfvgConfig("other"), lambda: gaps.BprConfig(polarity="other")):
        with pytest.raises(ValueError):
            make()


def test_streamed_bars_equal_the_batch(spark, tmp_path):
    from tidemark.streaming.bars import stream_bars

    rng = np.random.default_rng(5)
    rows = [("EURUSD", START + timedelta(seconds=int(s)), float(rng.normal() + 10), i) for i, s in enumerate(np.sort(rng.integers(0, 7200, 400)))] + [("EURUSD", START + timedelta(hours=9), 10.0, 999)]
    spark.createDataFrame(rows, "symbol string, timestamp timestamp, price double, seq long").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("symbol string, timestamp timestamp, price double, seq long").parquet(str(tmp_path / "in"))
    q = stream_bars(src, M5).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("streamed").drop("close_time").collect()}
    batch = B.ticks_to_bars(spark.read.parquet(str(tmp_path / "in")), M5, price="price", seq="seq")
    assert got == {tuple(r) for r in batch.filter(F.col("timestamp") < F.lit(START + timedelta(hours=3))).collect()} and got
