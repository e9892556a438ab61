"""DuckDB SQL that states each query anew, by plain joins and recursion."""

from __future__ import annotations

from tidemark.schema import SESSIONS

_BARS = """
bars0 AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS timestamp, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL),
bars AS (
  SELECT *, timestamp + INTERVAL '1 hour' AS close_time, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS idx FROM bars0)"""
_ID = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_TS = _ID.format

_H4 = """
h4a AS (
  SELECT symbol, time_bucket(INTERVAL '4 hours', timestamp) AS timestamp, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume
  FROM bars GROUP BY ALL),
h4 AS (
  SELECT h4a.*, h4a.timestamp + INTERVAL '4 hours' AS close_time FROM h4a
  JOIN (SELECT symbol, min(timestamp) AS a, max(close_time) AS z FROM bars GROUP BY symbol) e USING (symbol)
  WHERE h4a.timestamp >= a AND h4a.timestamp + INTERVAL '4 hours' <= z)"""

_RAW = """
raw AS (
  SELECT event_type AS symbol, ts, time_bucket(INTERVAL '1 hour', ts) AS timestamp, value AS open, value + event_id % 3 - 0.5 AS high, value - 0.25 AS low, value AS close, 1.0::DOUBLE AS volume, event_id AS seq FROM events),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, timestamp ORDER BY seq DESC) AS n, timestamp < lag(timestamp) OVER (PARTITION BY symbol ORDER BY seq) AS back,
         high >= greatest(open, close) AND low <= least(open, close) AND high >= low AND volume >= 0 AS ok FROM raw)"""

_SWINGS = f"""
nb AS (
  SELECT a.symbol, a.idx, a.timestamp, a.high, a.low,
         max(b.high) FILTER (b.idx < a.idx) AS hb, max(b.high) FILTER (b.idx > a.idx) AS ha, min(b.low) FILTER (b.idx < a.idx) AS lb, min(b.low) FILTER (b.idx > a.idx) AS la,
         count(*) AS n, max(b.close_time) AS confirmed
  FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.idx BETWEEN a.idx - 2 AND a.idx + 2 AND b.idx <> a.idx GROUP BY ALL HAVING count(*) = 4),
swings AS (
  SELECT symbol, 'bullish' AS direction, timestamp AS event_timestamp, confirmed AS confirmation_timestamp, high AS price_level, greatest(hb, ha) AS reference_level,
         'swing:' || symbol || ':1h:bullish:' || {_TS('timestamp')} AS swing_id FROM nb WHERE high > hb AND high >= ha
  UNION ALL
  SELECT symbol, 'bearish', timestamp, confirmed, low, least(lb, la), 'swing:' || symbol || ':1h:bearish:' || {_TS('timestamp')} FROM nb WHERE low < lb AND low <= la)"""

#: The state machine itself, bar by bar.
_BREAKS = f"""
admitted AS (
  SELECT b.symbol, b.idx, b.timestamp, b.close_time, b.close,
         arg_max(s.price_level, (s.confirmation_timestamp, s.event_timestamp)) FILTER (s.direction = 'bullish') AS nh, arg_max(s.event_timestamp, (s.confirmation_timestamp, s.event_timestamp)) FILTER (s.direction = 'bullish') AS nht,
         arg_max(s.price_level, (s.confirmation_timestamp, s.event_timestamp)) FILTER (s.direction = 'bearish') AS nl, arg_max(s.event_timestamp, (s.confirmation_timestamp, s.event_timestamp)) FILTER (s.direction = 'bearish') AS nlt
  FROM bars b LEFT JOIN bars p ON p.symbol = b.symbol AND p.idx = b.idx - 1
  LEFT JOIN swings s ON s.symbol = b.symbol AND s.confirmation_timestamp <= b.close_time AND (p.close_time IS NULL OR s.confirmation_timestamp > p.close_time)
  GROUP BY ALL),
machine AS (
  SELECT symbol, -1::BIGINT AS idx, NULL::TIMESTAMP AS timestamp, NULL::TIMESTAMP AS close_time, NULL::DOUBLE AS close, NULL::DOUBLE AS h, NULL::TIMESTAMP AS ht, NULL::DOUBLE AS l, NULL::TIMESTAMP AS lt,
         'undefined' AS state, 'undefined' AS before, NULL::DOUBLE AS level, NULL::TIMESTAMP AS level_ts FROM (SELECT DISTINCT symbol FROM bars)
  UNION ALL
  SELECT symbol, idx, timestamp, close_time, close, CASE WHEN up THEN NULL ELSE h2 END, CASE WHEN up THEN NULL ELSE ht2 END, CASE WHEN down THEN NULL ELSE l2 END, CASE WHEN down THEN NULL ELSE lt2 END,
         CASE WHEN up THEN 'bullish' WHEN down THEN 'bearish' ELSE state END, state, CASE WHEN up THEN h2 WHEN down THEN l2 END, CASE WHEN up THEN ht2 WHEN down THEN lt2 END
  FROM (SELECT *, coalesce(close > h2, false) AS up, NOT coalesce(close > h2, false) AND coalesce(close < l2, false) AS down FROM (
    SELECT a.*, m.state, coalesce(a.nh, m.h) AS h2, coalesce(a.nht, m.ht) AS ht2, coalesce(a.nl, m.l) AS l2, coalesce(a.nlt, m.lt) AS lt2 FROM machine m JOIN admitted a ON a.symbol = m.symbol AND a.idx = m.idx + 1))),
disp AS (
  SELECT a.symbol, a.idx, CASE WHEN count(*) = 20 AND avg(b.high - b.low) <> 0 THEN (a.high - a.low) / avg(b.high - b.low) END AS ratio
  FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.idx BETWEEN a.idx - 20 AND a.idx - 1 GROUP BY a.symbol, a.idx, a.high, a.low),
breaks0 AS (
  SELECT m.symbol, m.idx, CASE WHEN before = 'undefined' OR before = state THEN 'bos' WHEN ratio >= 1.5 THEN 'mss' ELSE 'choch' END AS event_type, state AS direction, before AS previous_state,
         timestamp AS event_timestamp, close_time AS confirmation_timestamp, close AS price_level, level AS reference_level, level_ts AS reference_swing_timestamp
  FROM machine m LEFT JOIN disp USING (symbol, idx) WHERE level IS NOT NULL),
breaks AS (
  SELECT *, 'break:' || symbol || ':1h:' || event_type || ':' || {_TS('event_timestamp')} AS break_id FROM breaks0)"""

_FVG = f"""
fvg AS (
  SELECT c.symbol, CASE WHEN c.low > a.high THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN c.low > a.high THEN c.low ELSE a.low END AS top, CASE WHEN c.low > a.high THEN a.high ELSE c.high END AS bottom,
         a.timestamp AS event_timestamp, b.timestamp AS formation_timestamp, c.close_time AS confirmation_timestamp, c.idx,
         'fvg:' || c.symbol || ':1h:' || CASE WHEN c.low > a.high THEN 'bullish' ELSE 'bearish' END || ':' || {_TS('b.timestamp')} AS zone_id
  FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.idx = a.idx + 1 AND b.timestamp = a.close_time JOIN bars c ON c.symbol = b.symbol AND c.idx = b.idx + 1 AND c.timestamp = b.close_time
  WHERE c.low > a.high OR c.high < a.low)"""


def _fills(zones: str, id_: str, start: str, name: str) -> str:
    """Fill progress of zones from the bar where `start` holds."""
    return f"""
{name}_r AS (
  SELECT z.symbol, z.{id_} AS zone_id, z.direction, z.top, z.bottom, b.idx, b.timestamp, b.close_time,
         CASE WHEN z.direction = 'bearish' THEN max(b.high) OVER w ELSE min(b.low) OVER w END AS extreme
  FROM {zones} z JOIN bars b ON b.symbol = z.symbol AND {start} WINDOW w AS (PARTITION BY z.symbol, z.{id_} ORDER BY b.idx)),
{name}_f AS (
  SELECT *, least(greatest(CASE WHEN direction = 'bearish' THEN (extreme - bottom) / (top - bottom) ELSE (top - extreme) / (top - bottom) END, 0.0), 1.0) AS f FROM {name}_r),
{name} AS (
  SELECT symbol, zone_id, idx, timestamp AS event_timestamp, close_time AS confirmation_timestamp, f AS fill_percentage, extreme AS deepest_price, CASE WHEN f >= 1 THEN 'mitigated' ELSE 'partially_filled' END AS status_after
  FROM (SELECT *, coalesce(lag(f) OVER (PARTITION BY symbol, zone_id ORDER BY idx), 0) AS before FROM {name}_f) WHERE f > before)"""


_IFVG = """
ifvg AS (
  SELECT z.*, h.idx AS hit, h.close_time AS hit_close, h.close AS trigger_close FROM fvg z JOIN LATERAL (
    SELECT idx, close_time, close FROM bars b WHERE b.symbol = z.symbol AND b.idx > z.idx AND b.idx <= z.idx + 500 AND CASE WHEN z.direction = 'bullish' THEN b.close < z.bottom ELSE b.close > z.top END
    ORDER BY idx LIMIT 1) h ON true)"""

_RUNS = """
ways AS (
  SELECT *, sign(close - open) AS way, CASE WHEN lag(close_time) OVER w IS DISTINCT FROM timestamp OR sign(close - open) IS DISTINCT FROM lag(sign(close - open)) OVER w THEN 1 ELSE 0 END AS new
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
runs AS (
  SELECT symbol, run, any_value(way) AS way, max(high) AS top, min(low) AS bottom, min(timestamp) AS first_ts, max(timestamp) AS last_ts, min(idx) AS run_start, max(idx) AS run_end, count(*) AS n, arg_min(open, idx) AS first_open
  FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM ways) WHERE way <> 0 GROUP BY symbol, run)"""

_OB = f"""
ob0 AS (
  SELECT r.*, CASE WHEN way < 0 THEN 'bullish' ELSE 'bearish' END AS direction,
         (SELECT min(idx) FROM bars b WHERE b.symbol = r.symbol AND b.idx > r.run_end AND b.idx <= r.run_end + 50 AND CASE WHEN r.way < 0 THEN b.close > r.top ELSE b.close < r.bottom END) AS hit
  FROM runs r WHERE top > bottom),
ob AS (
  SELECT o.symbol, o.direction, o.top, o.bottom, o.first_ts AS event_timestamp, b.close_time AS confirmation_timestamp, b.timestamp AS break_bar_timestamp, b.close AS break_close, (o.hit - o.run_end)::BIGINT AS bars_to_confirm, o.n::BIGINT AS candle_count,
         'ob:' || o.symbol || ':1h:' || o.direction || ':' || {_TS('o.first_ts')} AS order_block_id,
         (SELECT arg_min(z.zone_id, z.idx) FROM fvg z WHERE z.symbol = o.symbol AND z.direction = o.direction AND z.formation_timestamp >= o.last_ts AND z.confirmation_timestamp BETWEEN o.last_ts AND b.close_time) AS related_fvg_id
  FROM ob0 o JOIN bars b ON b.symbol = o.symbol AND b.idx = o.hit)"""

_FAILED = """
failed AS (
  SELECT o.*, f.idx AS failure_idx, f.timestamp AS failure_timestamp, f.close_time AS failed_at, f.close AS failure_close FROM ob o JOIN LATERAL (
    SELECT * FROM bars b WHERE b.symbol = o.symbol AND b.timestamp >= o.confirmation_timestamp AND CASE WHEN o.direction = 'bullish' THEN b.close < o.bottom ELSE b.close > o.top END ORDER BY idx LIMIT 1) f ON true)"""

_BREAKERS = """
breakers AS (
  SELECT f.symbol, 'breaker:' || f.symbol || ':1h:' || CASE WHEN f.direction = 'bullish' THEN 'bearish' ELSE 'bullish' END || ':' || strftime(f.failure_timestamp, '%Y-%m-%dT%H:%M:%S') || ':' || f.order_block_id AS breaker_id, CASE WHEN f.direction = 'bullish' THEN 'bearish' ELSE 'bullish' END AS direction, f.top, f.bottom, f.order_block_id AS source_order_block_id, s.break_id,
         f.failure_timestamp AS event_timestamp, greatest(f.confirmation_timestamp, s.confirmation_timestamp) AS confirmation_timestamp, f.failed_at, f.failure_close
  FROM failed f JOIN LATERAL (
    SELECT break_id, confirmation_timestamp FROM breaks k WHERE k.symbol = f.symbol AND k.direction <> f.direction AND k.idx BETWEEN f.failure_idx AND f.failure_idx + 20 ORDER BY k.idx LIMIT 1) s ON true)"""

_CISD = """
cisd0 AS (
  SELECT r.*, (SELECT min(idx) FROM bars b WHERE b.symbol = r.symbol AND b.idx > r.run_end AND b.idx <= r.run_end + 50 AND CASE WHEN r.way < 0 THEN b.close > r.first_open ELSE b.close < r.first_open END) AS hit FROM runs r),
cisd AS (
  SELECT *, coalesce(lag(direction) OVER (PARTITION BY symbol ORDER BY hit, run_start), 'undefined') AS previous_state FROM (SELECT *, CASE WHEN way < 0 THEN 'bullish' ELSE 'bearish' END AS direction FROM cisd0 WHERE hit IS NOT NULL)
  QUALIFY previous_state <> direction)"""

_RANGES = f"""
anchored AS (
  SELECT k.*, s.confirmation_timestamp AS own_confirmed, s.swing_id AS own_id, o.swing_id AS o_id, o.price_level AS o_price, o.confirmation_timestamp AS o_confirmed
  FROM breaks k JOIN swings s ON s.symbol = k.symbol AND s.direction = k.direction AND s.event_timestamp = k.reference_swing_timestamp
  LEFT JOIN LATERAL (SELECT * FROM swings x WHERE x.symbol = k.symbol AND x.direction <> k.direction AND x.confirmation_timestamp <= k.confirmation_timestamp AND x.event_timestamp < k.event_timestamp
    ORDER BY x.confirmation_timestamp DESC, x.event_timestamp DESC LIMIT 1) o ON true),
priced AS (
  SELECT *, CASE WHEN direction = 'bullish' THEN reference_level ELSE o_price END AS high_price, CASE WHEN direction = 'bullish' THEN o_price ELSE reference_level END AS low_price,
         CASE WHEN direction = 'bullish' THEN own_id ELSE o_id END AS high_source_id, CASE WHEN direction = 'bullish' THEN o_id ELSE own_id END AS low_source_id FROM anchored),
valid AS (
  SELECT *, lag(high_source_id) OVER w AS ph, lag(low_source_id) OVER w AS pl FROM priced WHERE high_price > low_price WINDOW w AS (PARTITION BY symbol ORDER BY confirmation_timestamp, event_timestamp)),
ranges0 AS (
  SELECT symbol, direction, high_price, low_price, (high_price + low_price) / 2 AS equilibrium_price, high_source_id, low_source_id, event_timestamp, greatest(confirmation_timestamp, own_confirmed, o_confirmed) AS confirmation_timestamp
  FROM valid WHERE ph IS NULL OR ph <> high_source_id OR pl <> low_source_id),
ranges AS (
  SELECT *, lead(confirmation_timestamp) OVER (PARTITION BY symbol ORDER BY confirmation_timestamp, range_id) AS superseded_at
  FROM (SELECT *, 'range:' || symbol || ':1h:' || direction || ':' || {_TS('confirmation_timestamp')} || ':' || high_source_id || '|' || low_source_id AS range_id FROM ranges0))"""

_DEFS = ", ".join(f"('{n}', '{z}', TIME '{a}:00', TIME '{b}:00')" for n, z, a, b in SESSIONS)


def _windows(defs: str, name: str) -> str:
    return f"""
{name}_d AS (
  SELECT * FROM (VALUES {defs}) v(name, zone, a, b), (SELECT unnest(generate_series((SELECT min(timestamp)::DATE - 2 FROM bars), (SELECT max(timestamp)::DATE + 2 FROM bars), INTERVAL '1 day'))::DATE AS local_date)),
{name} AS (
  SELECT name, local_date, timezone('UTC', timezone(zone, local_date + a)) AS start_utc, timezone('UTC', timezone(zone, (local_date + CASE WHEN b <= a THEN 1 ELSE 0 END)::DATE + b)) AS end_utc FROM {name}_d)"""


_SESSIONS = (
    _windows(_DEFS, "win")
    + """,
occ AS (
  SELECT symbol, name, local_date, start_utc, end_utc, arg_min(open, timestamp) AS open_price, max(high) AS high_price, min(low) AS low_price, arg_max(close, timestamp) AS close_price,
         arg_min(timestamp, (-high, timestamp)) AS high_timestamp, arg_min(timestamp, (low, timestamp)) AS low_timestamp, count(*)::BIGINT AS bar_count
  FROM bars JOIN win ON timestamp >= start_utc AND close_time <= end_utc GROUP BY ALL),
done AS (
  SELECT occ.* FROM occ JOIN (SELECT symbol, max(close_time) AS z FROM bars GROUP BY symbol) USING (symbol) WHERE z >= end_utc)"""
)
_PERIODS = (
    _windows("('day', 'America/New_York', TIME '17:00:00', TIME '17:00:00')", "dwin")
    + """,
dbars AS (
  SELECT bars.*, local_date, start_utc, end_utc, max(close_time) OVER (PARTITION BY symbol) AS z FROM bars JOIN dwin ON timestamp >= start_utc AND close_time <= end_utc),
ext AS (
  SELECT symbol, 'day' AS period, local_date AS label, any_value(end_utc) AS end_utc, max(high) AS high_price, min(low) AS low_price, arg_min(timestamp, (-high, timestamp)) AS high_timestamp, arg_min(timestamp, (low, timestamp)) AS low_timestamp, any_value(z) AS z FROM dbars GROUP BY symbol, local_date
  UNION ALL
  SELECT symbol, 'week', week, timezone('UTC', timezone('America/New_York', (week + 5)::DATE + TIME '17:00:00')), max(high), min(low), arg_min(timestamp, (-high, timestamp)), arg_min(timestamp, (low, timestamp)), any_value(z)
  FROM (SELECT *, local_date - (isodow(local_date) % 7)::INT AS week FROM dbars WHERE isodow(local_date) IN (7, 1, 2, 3, 4)) GROUP BY symbol, week),
periods AS (
  SELECT symbol, period || ':' || symbol || ':1h:previous_' || period || '_' || kind || ':' || label::VARCHAR AS level_id, 'previous_' || period || '_' || kind AS liquidity_type, CASE kind WHEN 'high' THEN 'buy_side' ELSE 'sell_side' END AS side,
         CASE kind WHEN 'high' THEN high_price ELSE low_price END AS price_level, CASE kind WHEN 'high' THEN high_timestamp ELSE low_timestamp END AS created_timestamp, end_utc AS confirmation_timestamp
  FROM ext, (VALUES ('high'), ('low')) k(kind) WHERE z >= end_utc)"""
)


def _equal(points: float) -> str:
    return f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY event_timestamp) AS n FROM swings),
equals AS (
  SELECT b.symbol, 'equal:' || b.symbol || ':1h:' || CASE WHEN b.direction = 'bullish' THEN 'equal_highs' ELSE 'equal_lows' END || ':' || {_TS('a.event_timestamp')} || ':' || {_TS('b.event_timestamp')} AS level_id,
         CASE WHEN b.direction = 'bullish' THEN 'equal_highs' ELSE 'equal_lows' END AS liquidity_type, CASE WHEN b.direction = 'bullish' THEN 'buy_side' ELSE 'sell_side' END AS side,
         CASE WHEN b.direction = 'bullish' THEN greatest(a.price_level, b.price_level) ELSE least(a.price_level, b.price_level) END AS price_level, b.event_timestamp AS created_timestamp, greatest(a.confirmation_timestamp, b.confirmation_timestamp) AS confirmation_timestamp
  FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND a.direction = b.direction AND a.n BETWEEN b.n - 5 AND b.n - 1 AND abs(a.price_level - b.price_level) <= {points} * 0.01::DOUBLE)"""


_LEVELS = (
    _equal(1.0)
    + ","
    + _SESSIONS
    + ","
    + _PERIODS
    + f""",
levels AS (
  SELECT symbol, 'swing:' || symbol || ':1h:' || direction || ':' || {_TS('event_timestamp')} AS level_id, CASE WHEN direction = 'bullish' THEN 'swing_high' ELSE 'swing_low' END AS liquidity_type,
         CASE WHEN direction = 'bullish' THEN 'buy_side' ELSE 'sell_side' END AS side, price_level, event_timestamp AS created_timestamp, confirmation_timestamp FROM swings
  UNION ALL SELECT * FROM equals
  UNION ALL SELECT symbol, 'session:' || symbol || ':1h:session_' || kind || ':' || name || ':' || local_date::VARCHAR, 'session_' || kind, CASE kind WHEN 'high' THEN 'buy_side' ELSE 'sell_side' END, CASE kind WHEN 'high' THEN high_price ELSE low_price END,
         CASE kind WHEN 'high' THEN high_timestamp ELSE low_timestamp END, end_utc FROM done, (VALUES ('high'), ('low')) k(kind)
  UNION ALL SELECT * FROM periods)"""
)
_SWEEPS = """
sweeps AS (
  SELECT l.symbol, l.level_id, l.side, h.timestamp AS event_timestamp, h.close_time AS confirmation_timestamp, l.price_level, CASE WHEN l.side = 'buy_side' THEN h.high ELSE h.low END AS extreme_price,
         CASE WHEN l.side = 'buy_side' THEN h.close > l.price_level ELSE h.close < l.price_level END AS closed_beyond
  FROM levels l JOIN LATERAL (SELECT * FROM bars b WHERE b.symbol = l.symbol AND b.close_time >= l.confirmation_timestamp AND CASE WHEN l.side = 'buy_side' THEN b.high > l.price_level ELSE b.low < l.price_level END ORDER BY idx LIMIT 1) h ON true)"""


_IFVG_ID = f"'ifvg:' || symbol || ':1h:' || {_TS('event_timestamp')} || ':' || zone_id"
#: Every zone of every kind, and the bar that fills it.
_ZONES = f"""
ifvg2 AS (
  SELECT i.symbol, CASE i.direction WHEN 'bullish' THEN 'bearish' ELSE 'bullish' END AS direction, i.top, i.bottom, b.timestamp AS event_timestamp, i.hit_close AS confirmation_timestamp, i.zone_id FROM ifvg i JOIN bars b ON b.symbol = i.symbol AND b.idx = i.hit),
bpr AS (
  SELECT u.symbol, CASE WHEN u.confirmation_timestamp >= d.confirmation_timestamp THEN 'bullish' ELSE 'bearish' END AS direction, least(u.top, d.top) AS top, greatest(u.bottom, d.bottom) AS bottom, greatest(u.event_timestamp, d.event_timestamp) AS event_timestamp,
         greatest(u.confirmation_timestamp, d.confirmation_timestamp) AS confirmation_timestamp, 'bpr|' || u.zone_id || '|' || d.zone_id AS id
  FROM fvg u JOIN fvg d ON u.symbol = d.symbol AND u.direction = 'bullish' AND d.direction = 'bearish' AND least(u.top, d.top) > greatest(u.bottom, d.bottom) AND abs(date_diff('hour', u.confirmation_timestamp, d.confirmation_timestamp)) <= 100),
rdrb AS (
  SELECT a.symbol, k.direction, CASE k.direction WHEN 'bullish' THEN d.low ELSE b.high END AS top, CASE k.direction WHEN 'bullish' THEN b.low ELSE d.high END AS bottom, a.timestamp AS event_timestamp, d.close_time AS confirmation_timestamp
  FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.idx = a.idx + 1 AND b.timestamp = a.close_time JOIN bars c ON c.symbol = a.symbol AND c.idx = a.idx + 2 AND c.timestamp = b.close_time JOIN bars d ON d.symbol = a.symbol AND d.idx = a.idx + 3 AND d.timestamp = c.close_time,
  (VALUES ('bullish'), ('bearish')) k(direction)
  WHERE CASE k.direction WHEN 'bullish' THEN a.close > a.open AND b.close > b.open AND d.close > d.open AND d.low > b.low ELSE a.close < a.open AND b.close < b.open AND d.close < d.open AND d.high < b.high END),
unis AS (
  SELECT k.symbol, k.direction, least(k.top, z.top) AS top, greatest(k.bottom, z.bottom) AS bottom, greatest(k.event_timestamp, z.event_timestamp) AS event_timestamp, greatest(k.confirmation_timestamp, z.confirmation_timestamp) AS confirmation_timestamp, k.breaker_id, z.zone_id
  FROM breakers k JOIN fvg z ON z.symbol = k.symbol AND z.direction = k.direction AND least(k.top, z.top) > greatest(k.bottom, z.bottom) AND abs(date_diff('hour', k.confirmation_timestamp, z.confirmation_timestamp)) <= 50),
zones AS (
  SELECT symbol, 'fvg' AS kind, zone_id AS id, direction, top, bottom, event_timestamp, confirmation_timestamp, NULL::VARCHAR AS parent FROM fvg
  UNION ALL SELECT symbol, 'ifvg', {_IFVG_ID}, direction, top, bottom, event_timestamp, confirmation_timestamp, NULL FROM ifvg2
  UNION ALL SELECT symbol, 'bpr', id, direction, top, bottom, event_timestamp, confirmation_timestamp, NULL FROM bpr
  UNION ALL SELECT symbol, 'rdrb', 'rdrb:' || symbol || ':1h:' || direction || ':' || {_TS('event_timestamp')}, direction, top, bottom, event_timestamp, confirmation_timestamp, NULL FROM rdrb
  UNION ALL SELECT symbol, 'ob', order_block_id, direction, top, bottom, event_timestamp, confirmation_timestamp, NULL FROM ob
  UNION ALL SELECT symbol, 'breaker', breaker_id, direction, top, bottom, event_timestamp, confirmation_timestamp, NULL FROM breakers
  UNION ALL SELECT symbol, 'unicorn', 'unicorn:' || symbol || ':1h:' || {_TS('confirmation_timestamp')} || ':' || breaker_id || '|' || zone_id, direction, top, bottom, event_timestamp, confirmation_timestamp, breaker_id FROM unis),
filled AS (
  SELECT z.*, (SELECT min(close_time) FROM bars b WHERE b.symbol = z.symbol AND b.timestamp >= z.confirmation_timestamp AND CASE z.direction WHEN 'bearish' THEN b.high >= z.top ELSE b.low <= z.bottom END) AS full_at FROM zones z),
items AS (
  SELECT f.symbol, f.kind, f.id, f.direction, (f.top + f.bottom) / 2 AS value, f.event_timestamp, f.confirmation_timestamp, CASE f.kind WHEN 'ob' THEN least(coalesce(f.full_at, x.failed_at), coalesce(x.failed_at, f.full_at)) WHEN 'unicorn' THEN least(coalesce(f.full_at, p.full_at), coalesce(p.full_at, f.full_at)) ELSE f.full_at END AS dead_at
  FROM filled f LEFT JOIN failed x ON x.order_block_id = f.id LEFT JOIN filled p ON p.kind = 'breaker' AND p.id = f.parent
  UNION ALL
  SELECT l.symbol, 'level', l.level_id, l.side, l.price_level, l.created_timestamp, l.confirmation_timestamp, s.confirmation_timestamp FROM levels l LEFT JOIN sweeps s ON s.level_id = l.level_id),
alive AS (
  SELECT b.symbol, b.idx, b.close, b.close_time, i.kind, i.id, i.direction, i.value, i.event_timestamp, i.confirmation_timestamp FROM bars b JOIN items i ON i.symbol = b.symbol AND i.confirmation_timestamp <= b.close_time AND (i.dead_at IS NULL OR i.dead_at > b.close_time))"""
_ALL = (_SWINGS, _BREAKS, _FVG, _IFVG, _RUNS, _OB, _FAILED, _BREAKERS, _CISD, _RANGES, _LEVELS, _SWEEPS, _ZONES)

_OPENS = """
opens AS (
  SELECT symbol, open AS price, timestamp AS at FROM bars WHERE timezone('America/New_York', timezone('UTC', timestamp)) = date_trunc('day', timezone('America/New_York', timezone('UTC', timestamp))))"""
_VECTOR = """
counted AS (
  SELECT symbol, idx, """ + ", ".join(f"count(*) FILTER (kind = '{k}'{f' AND direction = {chr(39)}{d}{chr(39)}' if d else ''}) AS {c}" for c, (k, d) in {
    "buy_side_liquidity_count": ("level", "buy_side"), "sell_side_liquidity_count": ("level", "sell_side"), "bullish_fvg_count": ("fvg", "bullish"), "bearish_fvg_count": ("fvg", "bearish"), "ifvg_count": ("ifvg", None), "bpr_count": ("bpr", None), "bullish_order_block_count": ("ob", "bullish"),
    "bearish_order_block_count": ("ob", "bearish"), "bullish_breaker_count": ("breaker", "bullish"), "bearish_breaker_count": ("breaker", "bearish"), "rdrb_count": ("rdrb", None), "unicorn_count": ("unicorn", None)}.items()) + ", " + ", ".join(
    f"min(abs(value - close)) FILTER (kind = '{k}' AND direction = '{d}') / 0.01 AS {c}" for c, (k, d) in {"nearest_buy_side_points": ("level", "buy_side"), "nearest_sell_side_points": ("level", "sell_side"), "nearest_bullish_fvg_points": ("fvg", "bullish"), "nearest_bearish_fvg_points": ("fvg", "bearish")}.items()) + ", " + ", ".join(
    f"arg_max(CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END, (confirmation_timestamp, event_timestamp, id)) FILTER (kind = '{k}') AS latest_{k}_direction_code" for k in ("ifvg", "breaker", "unicorn")) + """ FROM alive GROUP BY symbol, idx),
lastbreak AS (
  SELECT b.symbol, b.idx, arg_max(k.direction, k.idx) AS kd, arg_max(k.event_type, k.idx) AS kt, arg_max(k.reference_level, k.idx) AS kl, max(k.idx) AS ki, count(*) FILTER (k.event_type = 'bos') AS bos_count, count(*) FILTER (k.event_type = 'mss') AS mss_count, count(*) FILTER (k.event_type = 'choch') AS choch_count
  FROM bars b JOIN breaks k ON k.symbol = b.symbol AND k.confirmation_timestamp <= b.close_time GROUP BY b.symbol, b.idx),
lastsweep AS (
  SELECT b.symbol, b.idx, arg_max(s.side, (s.confirmation_timestamp, s.event_timestamp, s.level_id)) AS ss, arg_max(NOT s.closed_beyond, (s.confirmation_timestamp, s.event_timestamp, s.level_id)) AS sr, max(s.confirmation_timestamp) AS sc
  FROM bars b JOIN sweeps s ON s.symbol = b.symbol AND s.confirmation_timestamp <= b.close_time GROUP BY b.symbol, b.idx),
lastcisd AS (
  SELECT b.symbol, b.idx, arg_max(c.direction, c.hit) AS cd, max(c.hit) AS ch FROM bars b JOIN cisd c ON c.symbol = b.symbol AND c.hit <= b.idx GROUP BY b.symbol, b.idx),
lastopen AS (
  SELECT b.symbol, b.idx, arg_max(o.price, o.at) AS op, max(o.at) AS oa FROM bars b JOIN opens o ON o.symbol = b.symbol AND o.at <= b.close_time GROUP BY b.symbol, b.idx),
lastrange AS (
  SELECT b.symbol, b.idx, arg_max((r.high_price, r.low_price, r.equilibrium_price, r.direction), (r.confirmation_timestamp, r.range_id)) AS r FROM bars b JOIN ranges r ON r.symbol = b.symbol AND r.confirmation_timestamp <= b.close_time GROUP BY b.symbol, b.idx),
insession AS (
  SELECT b.symbol, b.idx, count(*) AS n, arg_min(start_utc, (name, start_utc)) AS s0 FROM bars b JOIN win ON start_utc <= b.close_time AND b.close_time < end_utc GROUP BY b.symbol, b.idx),
vec AS (
  SELECT b.*, counted.* EXCLUDE (symbol, idx), kd, kt, kl, ki, bos_count, mss_count, choch_count, ss, sr, sc, cd, ch, op, oa, r[1] AS hi, r[2] AS lo, r[3] AS eq, r[4] AS rd, insession.n AS ns, s0,
         CASE WHEN r IS NULL THEN NULL WHEN abs(b.close - r[3]) <= 0.5 * 0.01::DOUBLE THEN 'equilibrium' WHEN b.close > r[3] THEN 'premium' ELSE 'discount' END AS zone
  FROM bars b LEFT JOIN counted USING (symbol, idx) LEFT JOIN lastbreak USING (symbol, idx) LEFT JOIN lastsweep USING (symbol, idx) LEFT JOIN lastcisd USING (symbol, idx) LEFT JOIN lastopen USING (symbol, idx)
  LEFT JOIN (SELECT symbol, idx, row(r[1], r[2], r[3], r[4]) AS r0, r FROM lastrange) lr USING (symbol, idx) LEFT JOIN insession USING (symbol, idx)),
votes AS (
  SELECT *, (coalesce(kd = 'bullish', false)::INT + coalesce(cd = 'bullish', false)::INT + coalesce(zone = 'discount', false)::INT + coalesce(ss = 'sell_side', false)::INT) AS up,
         (coalesce(kd = 'bearish', false)::INT + coalesce(cd = 'bearish', false)::INT + coalesce(zone = 'premium', false)::INT + coalesce(ss = 'buy_side', false)::INT) AS down FROM vec)"""
_WAY = "CASE {0} WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 END"
_FEATURE_SQL = {
    "close": "close", "distance_from_true_daily_open_points": "(close - op) / 0.01", "distance_from_equilibrium_points": "(close - eq) / 0.01", "percentage_position": "(close - lo) / (hi - lo)", "is_premium": "(zone = 'premium')::INT", "is_discount": "(zone = 'discount')::INT", "is_equilibrium": "(zone = 'equilibrium')::INT",
    "dealing_range_width_points": "(hi - lo) / 0.01", "dealing_range_direction_code": _WAY.format("rd"), "structure_state_code": f"coalesce({_WAY.format('kd')}, 0)", "structure_direction_code": f"coalesce({_WAY.format('kd')}, 0)", "latest_break_type_code": "CASE kt WHEN 'bos' THEN 1 WHEN 'mss' THEN 2 WHEN 'choch' THEN 3 END",
    "latest_break_direction_code": _WAY.format("kd"), "has_bos": "(coalesce(bos_count, 0) > 0)::INT", "has_mss": "(coalesce(mss_count, 0) > 0)::INT", "has_choch": "(coalesce(choch_count, 0) > 0)::INT", "bos_count": "coalesce(bos_count, 0)", "mss_count": "coalesce(mss_count, 0)", "choch_count": "coalesce(choch_count, 0)",
    "bars_since_structural_break": "idx - ki", "distance_from_structural_level_points": "(close - kl) / 0.01", "buy_side_liquidity_count": "coalesce(buy_side_liquidity_count, 0)", "sell_side_liquidity_count": "coalesce(sell_side_liquidity_count, 0)", "nearest_buy_side_points": "nearest_buy_side_points", "nearest_sell_side_points": "nearest_sell_side_points",
    "has_recent_sweep": "(ss IS NOT NULL)::INT", "latest_sweep_side_code": "CASE ss WHEN 'buy_side' THEN -1 WHEN 'sell_side' THEN 1 END", "latest_sweep_is_rejection": "sr::INT", "bars_since_sweep": "(SELECT count(*) FROM bars c WHERE c.symbol = votes.symbol AND c.close_time > votes.sc AND c.close_time <= votes.close_time) + CASE WHEN sc IS NULL THEN NULL ELSE 0 END",
    **{c: f"coalesce({c}, 0)" for c in ("bullish_fvg_count", "bearish_fvg_count")}, "nearest_bullish_fvg_points": "nearest_bullish_fvg_points", "nearest_bearish_fvg_points": "nearest_bearish_fvg_points", "ifvg_count": "coalesce(ifvg_count, 0)", "latest_ifvg_direction_code": "latest_ifvg_direction_code", "bpr_count": "coalesce(bpr_count, 0)",
    **{c: f"coalesce({c}, 0)" for c in ("bullish_order_block_count", "bearish_order_block_count", "bullish_breaker_count", "bearish_breaker_count")}, "latest_breaker_direction_code": "latest_breaker_direction_code", "rdrb_count": "coalesce(rdrb_count, 0)", "has_cisd": "(cd IS NOT NULL)::INT", "delivery_state_code": f"coalesce({_WAY.format('cd')}, 0)", "bars_since_cisd": "idx - ch",
    "unicorn_count": "coalesce(unicorn_count, 0)", "latest_unicorn_direction_code": "latest_unicorn_direction_code", "trading_day_age_minutes": "date_diff('minute', oa, close_time)", "session_elapsed_minutes": "date_diff('minute', s0, close_time)", "minute_of_session": "date_diff('minute', s0, close_time)", "active_session_count": "coalesce(ns, 0)",
    "day_of_week": "isodow(close_time) - 1", "hour_of_day": "hour(close_time)", "bias_code": "sign(up - down)", "bullish_evidence_count": "up", "bearish_evidence_count": "down",
}


def _target_sql() -> str:
    base = """
tb AS (
  SELECT *, lead(close, 4) OVER w AS c4, lead(close_time, 4) OVER w AS e4, lead(close_time, 8) OVER w AS e8, CASE WHEN lead(close_time, 4) OVER w IS NOT NULL THEN max(high) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) END AS h4,
         CASE WHEN lead(close_time, 4) OVER w IS NOT NULL THEN min(low) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) END AS l4 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
race AS (
  SELECT a.symbol, a.idx, arg_min((b.close_time, b.high >= a.close + 3000.0 * 0.01::DOUBLE, b.low <= a.close - 3000.0 * 0.01::DOUBLE), b.idx) AS x FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx + 1 AND a.idx + 8 AND (b.high >= a.close + 3000.0 * 0.01::DOUBLE OR b.low <= a.close - 3000.0 * 0.01::DOUBLE) GROUP BY a.symbol, a.idx),
short AS (
  SELECT a.symbol, a.idx, arg_min((b.close_time, b.high >= a.close + 2500.0 * 0.01::DOUBLE, b.low <= a.close - 2000.0 * 0.01::DOUBLE), b.idx) AS x FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx + 1 AND a.idx + 8 AND (b.high >= a.close + 2500.0 * 0.01::DOUBLE OR b.low <= a.close - 2000.0 * 0.01::DOUBLE) GROUP BY a.symbol, a.idx),
tv AS (
  SELECT symbol, idx, close_time AS as_of, 'ret_4' AS spec_name, 'future_return' AS target_type, c4 IS NOT NULL AS resolved, CASE WHEN c4 IS NULL THEN 'insufficient_history' END AS unresolved_reason, round((c4 - close) / close, 9) AS future_return, round((c4 - close) / 0.01, 6) AS future_move_points, NULL::VARCHAR AS direction,
         NULL::DOUBLE AS up_excursion_points, NULL::DOUBLE AS down_excursion_points, NULL::VARCHAR AS outcome, NULL::TIMESTAMP AS resolving_bar_timestamp, e4 AS future_window_end FROM tb
  UNION ALL SELECT symbol, idx, close_time, 'dir_4', 'direction', c4 IS NOT NULL, CASE WHEN c4 IS NULL THEN 'insufficient_history' END, round((c4 - close) / close, 9), round((c4 - close) / 0.01, 6), CASE WHEN round((c4 - close) / 0.01, 6) >= 2000 THEN 'up' WHEN round((c4 - close) / 0.01, 6) <= -2000 THEN 'down' WHEN c4 IS NOT NULL THEN 'neutral' END, NULL, NULL, NULL, NULL, e4 FROM tb
  UNION ALL SELECT symbol, idx, close_time, 'exc_4', 'excursion', e4 IS NOT NULL, CASE WHEN e4 IS NULL THEN 'insufficient_history' END, NULL, NULL, NULL, round((h4 - close) / 0.01, 6), round((close - l4) / 0.01, 6), NULL, NULL, e4 FROM tb
  UNION ALL SELECT tb.symbol, tb.idx, close_time, 'tpsl_8', 'tp_before_sl', x IS NOT NULL AND NOT (x[2] AND x[3]), CASE WHEN x IS NULL THEN CASE WHEN e8 IS NULL THEN 'insufficient_history' ELSE 'no_touch_within_horizon' END WHEN x[2] AND x[3] THEN 'same_bar_ambiguity' END, NULL, NULL, NULL, NULL, NULL,
         CASE WHEN x IS NULL OR (x[2] AND x[3]) THEN 'unresolved' WHEN x[2] THEN 'tp_first' ELSE 'sl_first' END, x[1], e8 FROM tb LEFT JOIN race ON race.symbol = tb.symbol AND race.idx = tb.idx
  UNION ALL SELECT tb.symbol, tb.idx, close_time, 'short_8', 'tp_before_sl', x IS NOT NULL AND NOT (x[2] AND x[3]), CASE WHEN x IS NULL THEN CASE WHEN e8 IS NULL THEN 'insufficient_history' ELSE 'no_touch_within_horizon' END WHEN x[2] AND x[3] THEN 'same_bar_ambiguity' END, NULL, NULL, NULL, NULL, NULL,
         CASE WHEN x IS NULL OR (x[2] AND x[3]) THEN 'unresolved' WHEN x[3] THEN 'tp_first' ELSE 'sl_first' END, x[1], e8 FROM tb LEFT JOIN short ON short.symbol = tb.symbol AND short.idx = tb.idx)"""
    return base


#: Every event of every detector, with its status at the end of the bars.
_EVENTS = f"""
dead AS (
  SELECT f.*, x.failed_at, p.full_at AS parent_full_at FROM filled f LEFT JOIN failed x ON f.kind = 'ob' AND x.order_block_id = f.id LEFT JOIN filled p ON p.kind = 'breaker' AND p.id = f.parent),
edged AS (
  SELECT *, (top + bottom) / 2 AS mid, (top - bottom) / 0.01::DOUBLE AS points, CASE direction WHEN 'bullish' THEN top ELSE bottom END AS entry, CASE direction WHEN 'bullish' THEN bottom ELSE top END AS far, CASE WHEN full_at IS NOT NULL THEN 'mitigated' ELSE 'active' END AS state,
         CASE WHEN coalesce(failed_at, parent_full_at) IS NOT NULL THEN 'invalidated' WHEN full_at IS NOT NULL THEN 'mitigated' ELSE 'active' END AS own_state FROM dead),
lab0 AS (
  SELECT *, lag(price_level) OVER w AS p, lag(confirmation_timestamp) OVER w AS pc FROM swings WINDOW w AS (PARTITION BY symbol, direction ORDER BY confirmation_timestamp, event_timestamp)),
lab1 AS (
  SELECT *, CASE WHEN direction = 'bullish' THEN CASE WHEN price_level > p THEN 'higher_high' ELSE 'lower_high' END ELSE CASE WHEN price_level > p THEN 'higher_low' ELSE 'lower_low' END END AS label FROM lab0 WHERE price_level <> p),
moments AS (
  SELECT symbol, name, local_date, min(timestamp) AS open_timestamp, max(timestamp) AS close_timestamp FROM bars JOIN win ON timestamp >= start_utc AND close_time <= end_utc GROUP BY ALL),
events_all AS (
  SELECT symbol, 'swings' AS detector, CASE direction WHEN 'bullish' THEN 'swing_high' ELSE 'swing_low' END AS event_type, direction, event_timestamp, confirmation_timestamp, price_level, reference_level, abs(price_level - reference_level) / 0.01::DOUBLE AS strength,
         NULL::TIMESTAMP AS created_timestamp, NULL::TIMESTAMP AS invalidation_timestamp, 'active' AS status, swing_id AS source_id FROM swings
  UNION ALL SELECT symbol, 'structure', label, CASE WHEN price_level > p THEN 'bullish' ELSE 'bearish' END, event_timestamp, greatest(confirmation_timestamp, pc), price_level, p, abs(price_level - p) / 0.01::DOUBLE, NULL, NULL, 'active', 'label:' || symbol || ':1h:' || label || ':' || {_TS('event_timestamp')} FROM lab1
  UNION ALL SELECT symbol, 'structure', event_type, direction, event_timestamp, confirmation_timestamp, price_level, reference_level, abs(price_level - reference_level) / 0.01::DOUBLE, NULL, NULL, 'active', break_id FROM breaks
  UNION ALL SELECT l.symbol, 'liquidity', l.liquidity_type, CASE l.side WHEN 'buy_side' THEN 'bullish' ELSE 'bearish' END, l.created_timestamp, l.confirmation_timestamp, l.price_level, NULL, NULL, l.created_timestamp, NULL, CASE WHEN s.level_id IS NULL THEN 'active' ELSE 'swept' END, l.level_id FROM levels l LEFT JOIN sweeps s ON s.level_id = l.level_id
  UNION ALL SELECT symbol, 'liquidity', 'liquidity_sweep', CASE side WHEN 'buy_side' THEN 'bullish' ELSE 'bearish' END, event_timestamp, confirmation_timestamp, extreme_price, price_level, abs(extreme_price - price_level) / 0.01::DOUBLE, NULL, NULL, 'swept', level_id FROM sweeps
  UNION ALL SELECT e.symbol, 'fvg', 'fvg_' || e.direction, e.direction, z.formation_timestamp, e.confirmation_timestamp, mid, entry, points, z.formation_timestamp, full_at, state, id FROM edged e JOIN fvg z ON e.kind = 'fvg' AND z.zone_id = e.id
  UNION ALL SELECT e.symbol, 'ifvg', 'ifvg_' || e.direction, e.direction, e.event_timestamp, e.confirmation_timestamp, mid, b.close, e.top - e.bottom, e.event_timestamp, NULL, state, id FROM edged e JOIN bars b ON e.kind = 'ifvg' AND b.symbol = e.symbol AND b.timestamp = e.event_timestamp
  UNION ALL SELECT symbol, 'order_blocks', 'order_block_' || direction, direction, event_timestamp, confirmation_timestamp, mid, entry, NULL, event_timestamp, failed_at, own_state, id FROM edged WHERE kind = 'ob'
  UNION ALL SELECT symbol, 'breakers', 'breaker_' || direction, direction, event_timestamp, confirmation_timestamp, mid, far, NULL, event_timestamp, NULL, state, id FROM edged WHERE kind = 'breaker'
  UNION ALL SELECT symbol, 'bpr', 'balanced_price_range', direction, event_timestamp, confirmation_timestamp, mid, top, points, event_timestamp, NULL, state, id FROM edged WHERE kind = 'bpr'
  UNION ALL SELECT symbol, 'rdrb', 'rdrb_' || direction, direction, event_timestamp, confirmation_timestamp, mid, far, points, event_timestamp, NULL, state, id FROM edged WHERE kind = 'rdrb'
  UNION ALL SELECT c.symbol, 'cisd', 'cisd_' || c.direction, c.direction, b.timestamp, b.close_time, c.first_open, b.close, NULL, b.timestamp, NULL, 'active', 'cisd:' || c.symbol || ':1h:' || c.direction || ':' || {_TS('b.timestamp')} FROM cisd c JOIN bars b ON b.symbol = c.symbol AND b.idx = c.hit
  UNION ALL SELECT symbol, 'unicorns', 'unicorn_' || direction, direction, event_timestamp, confirmation_timestamp, mid, top, points, event_timestamp, NULL, own_state, id FROM edged WHERE kind = 'unicorn'
  UNION ALL SELECT symbol, 'ranges', 'dealing_range', direction, event_timestamp, confirmation_timestamp, equilibrium_price, high_price, high_price - low_price, event_timestamp, NULL, CASE WHEN superseded_at IS NULL THEN 'active' ELSE 'invalidated' END, range_id FROM ranges
  UNION ALL SELECT symbol, 'daily_opens', 'true_daily_open', 'neutral', o.at, o.at, price, NULL, NULL, o.at, NULL, 'active', 'tdo:' || symbol || ':1h:' || timezone('America/New_York', timezone('UTC', o.at))::DATE::VARCHAR FROM opens o
  UNION ALL SELECT d.symbol, 'sessions', 'session_' || k.kind, CASE k.kind WHEN 'high' THEN 'bullish' WHEN 'low' THEN 'bearish' ELSE 'neutral' END, CASE k.kind WHEN 'high' THEN high_timestamp WHEN 'low' THEN low_timestamp WHEN 'open' THEN open_timestamp ELSE close_timestamp END, end_utc,
         CASE k.kind WHEN 'high' THEN high_price WHEN 'low' THEN low_price WHEN 'open' THEN open_price ELSE close_price END, open_price, (high_price - low_price) / 0.01::DOUBLE, start_utc, NULL, 'active', 'session:' || d.symbol || ':1h:session_' || k.kind || ':' || d.name || ':' || d.local_date::VARCHAR
  FROM done d JOIN moments USING (symbol, name, local_date), (VALUES ('high'), ('low'), ('open'), ('close')) k(kind))"""

_SPLITS = """
cut AS (
  SELECT symbol, arg_min(close_time, idx) FILTER (idx = greatest(1, floor(n * 0.6::DOUBLE))) AS a, arg_min(close_time, idx) FILTER (idx = greatest(greatest(1, floor(n * 0.6::DOUBLE)) + 1, floor(n * (0.6::DOUBLE + 0.2::DOUBLE)))) AS b
  FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) GROUP BY symbol),
lab AS (
  SELECT t.symbol, t.close_time AS as_of, CASE WHEN close_time < a THEN 'train' WHEN close_time < b THEN 'validation' ELSE 'test' END AS natural_label, e8, lead(close_time, 8) OVER (PARTITION BY symbol ORDER BY idx) AS later, CASE WHEN close_time < a THEN a WHEN close_time < b THEN b END AS bound FROM tb t JOIN cut USING (symbol)),
labelled AS (
  SELECT symbol, as_of, natural_label, CASE WHEN coalesce(coalesce(e8, later) >= bound, false) THEN 'embargoed' ELSE natural_label END AS label FROM lab)"""

_GRID = """
every AS (
  SELECT symbol, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL '1 hour')) AS timestamp FROM bars GROUP BY symbol),
g AS (
  SELECT e.symbol, e.timestamp, b.idx IS NOT NULL AS seen, isodow(e.timestamp) - 1 AS weekday, hour(e.timestamp) * 60 AS minute FROM every e LEFT JOIN bars b ON b.symbol = e.symbol AND b.timestamp = e.timestamp),
shut AS (
  SELECT symbol, weekday, minute, count(*) AS occurrences FROM g GROUP BY symbol, weekday, minute HAVING count(*) FILTER (seen) = 0 AND count(*) >= 2),
gs AS (
  SELECT g.*, s.occurrences IS NOT NULL AS shut, time_bucket(INTERVAL '4 hours', timestamp) AS bar FROM g LEFT JOIN shut s USING (symbol, weekday, minute)),
ends AS (
  SELECT symbol, min(timestamp) AS a, max(close_time) AS z FROM bars GROUP BY symbol)"""
_COVER = """
runs4 AS (
  SELECT symbol, bar, island, count(*) FILTER (NOT seen) AS n FROM (SELECT *, count(*) FILTER (seen) OVER (PARTITION BY symbol, bar ORDER BY timestamp) AS island FROM gs) GROUP BY ALL),
cov0 AS (
  SELECT gs.symbol, gs.bar AS timestamp, 4::BIGINT AS expected, count(*) FILTER (seen)::BIGINT AS actual, count(*) FILTER (NOT seen AND shut)::BIGINT AS market_closed, count(*) FILTER (NOT seen AND NOT shut)::BIGINT AS undetermined, any_value(gs.bar < a OR gs.bar + INTERVAL '4 hours' > z) AS boundary_incomplete
  FROM gs JOIN ends USING (symbol) GROUP BY gs.symbol, gs.bar HAVING count(*) FILTER (seen) > 0),
cov AS (
  SELECT c.*, (SELECT max(n) FROM runs4 r WHERE r.symbol = c.symbol AND r.bar = c.timestamp)::BIGINT AS longest_missing_run, CASE WHEN boundary_incomplete THEN 'boundary' WHEN actual = 4 THEN 'none' WHEN undetermined = 0 THEN 'market_closed' ELSE 'undetermined' END AS cause FROM cov0 c),
covq AS (
  SELECT *, CASE cause WHEN 'boundary' THEN 'boundary_incomplete' WHEN 'none' THEN 'complete' WHEN 'market_closed' THEN 'market_gap' ELSE 'degraded_unknown' END AS quality, NOT boundary_incomplete AS production_eligible FROM cov),
h4w AS (
  SELECT h.symbol, h.timestamp, actual AS present_hours, 4 - actual AS missing_hours, coalesce((SELECT count(*) FROM (SELECT unnest(generate_series(h.timestamp, h.timestamp + INTERVAL '3 hours', INTERVAL '1 hour')) AS t) x JOIN shut s ON s.symbol = h.symbol AND s.weekday = isodow(x.t) - 1 AND s.minute = hour(x.t) * 60 WHERE x.t NOT IN (SELECT timestamp FROM bars b WHERE b.symbol = h.symbol)), 0)::BIGINT AS closed_hours, h.open, h.high, h.low, h.close, h.volume, boundary_incomplete
  FROM h4a h JOIN cov0 c USING (symbol, timestamp)),
h4d AS (
  SELECT *, CASE WHEN boundary_incomplete THEN 'withheld_boundary' WHEN missing_hours = 0 THEN 'emitted' WHEN closed_hours = missing_hours THEN 'withheld_market_closed' ELSE 'withheld_undetermined' END AS disposition FROM h4w)"""
_QUOTES = """
q AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS timestamp, CASE event_id % 7 WHEN 1 THEN NULL WHEN 2 THEN -value ELSE floor(value) END::DOUBLE AS bid, (floor(value) + CASE event_id % 7 WHEN 3 THEN -1 ELSE 1 END)::DOUBLE AS ask, CASE event_id % 7 WHEN 4 THEN -1.0 ELSE 1.0 END AS bid_volume, event_id AS seq FROM events),
qf AS (
  SELECT *, bid IS NULL OR ask IS NULL AS missing, coalesce(bid <= 0 OR ask <= 0, false) AS nonpositive, coalesce(bid > ask, false) AS crossed, bid_volume < 0 AS negative_volume FROM q),
qn AS (
  SELECT *, NOT (missing OR nonpositive OR crossed OR negative_volume) AS ok, row_number() OVER (PARTITION BY symbol, timestamp, bid, ask, NOT (missing OR nonpositive OR crossed OR negative_volume) ORDER BY seq) AS n FROM qf)"""


def sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip("\n") for p in (_BARS, *parts)) + "\n" + select


#: What a state names: ids of the nearest, the latest, and what they came from.
_LATEST_SQL = {"latest_bullish_fvg_id": ("fvg", "bullish"), "latest_bearish_fvg_id": ("fvg", "bearish"), "latest_ifvg_id": ("ifvg", None), "latest_bpr_id": ("bpr", None), "latest_bullish_order_block_id": ("ob", "bullish"), "latest_bearish_order_block_id": ("ob", "bearish"), "latest_breaker_id": ("breaker", None), "latest_rdrb_id": ("rdrb", None), "latest_unicorn_id": ("unicorn", None)}
_NEAREST_SQL = {"nearest_buy_side": ("level", "buy_side"), "nearest_sell_side": ("level", "sell_side"), "nearest_bullish_fvg": ("fvg", "bullish"), "nearest_bearish_fvg": ("fvg", "bearish")}


def _which(kind: str, direction: str | None) -> str:
    return f"FILTER (kind = '{kind}'" + (f" AND direction = '{direction}')" if direction else ")")


_CONTEXT = (
    "named AS (SELECT symbol, idx, "
    + ", ".join(f"arg_min({v}, (abs(value - close), id)) {_which(*k)} AS {c}_{n}" for c, k in _NEAREST_SQL.items() for v, n in (("id", "id"), ("value", "price")))
    + ", " + ", ".join(f"arg_max(id, (confirmation_timestamp, event_timestamp, id)) {_which(*k)} AS {c}" for c, k in _LATEST_SQL.items()) + " FROM alive GROUP BY symbol, idx)",
    "lastid AS (SELECT b.symbol, b.idx, arg_max(k.break_id, k.idx) AS break_id, " + ", ".join(f"arg_max(k.break_id, k.idx) FILTER (k.event_type = '{t}') AS latest_{t}_id" for t in ("bos", "mss", "choch"))
    + ", arg_max(abs(k.price_level - k.reference_level) / 0.01::DOUBLE, k.idx) AS break_distance_points FROM bars b JOIN breaks k ON k.symbol = b.symbol AND k.idx <= b.idx GROUP BY b.symbol, b.idx)",
    "lastswept AS (SELECT b.symbol, b.idx, arg_max(s.level_id, (s.confirmation_timestamp, s.event_timestamp, s.level_id)) AS sweep_level_id FROM bars b JOIN sweeps s ON s.symbol = b.symbol AND s.confirmation_timestamp <= b.close_time GROUP BY b.symbol, b.idx)",
    f"lastturn AS (SELECT b.symbol, b.idx, arg_max('cisd:' || c.symbol || ':1h:' || c.direction || ':' || {_TS('x.timestamp')}, c.hit) AS cisd_id FROM bars b JOIN cisd c ON c.symbol = b.symbol AND c.hit <= b.idx JOIN bars x ON x.symbol = c.symbol AND x.idx = c.hit GROUP BY b.symbol, b.idx)",
    "lastday AS (SELECT b.symbol, b.idx, 'tdo:' || b.symbol || ':1h:' || timezone('America/New_York', timezone('UTC', max(o.at)))::DATE::VARCHAR AS daily_open_id FROM bars b JOIN opens o ON o.symbol = b.symbol AND o.at <= b.close_time GROUP BY b.symbol, b.idx)",
    "lastanchor AS (SELECT b.symbol, b.idx, arg_max(r.range_id, (r.confirmation_timestamp, r.range_id)) AS range_id, arg_max(r.high_source_id, (r.confirmation_timestamp, r.range_id)) AS high_anchor_id, arg_max(r.low_source_id, (r.confirmation_timestamp, r.range_id)) AS low_anchor_id, "
    "arg_max(k.break_id, (r.confirmation_timestamp, r.range_id)) AS range_break_id FROM bars b JOIN ranges r ON r.symbol = b.symbol AND r.confirmation_timestamp <= b.close_time JOIN breaks k ON k.symbol = r.symbol AND k.event_timestamp = r.event_timestamp GROUP BY b.symbol, b.idx)",
    f"uni_ids AS (SELECT 'unicorn:' || u.symbol || ':1h:' || {_TS('u.confirmation_timestamp')} || ':' || u.breaker_id || '|' || u.zone_id AS latest_unicorn_id, u.zone_id AS latest_unicorn_fvg_id, u.breaker_id AS latest_unicorn_breaker_id, k.source_order_block_id AS latest_unicorn_order_block_id FROM unis u JOIN breakers k ON k.breaker_id = u.breaker_id)",
    "ctx AS (SELECT b.symbol, b.idx, b.close_time AS as_of, lastid.break_id, latest_bos_id, latest_mss_id, latest_choch_id, round(break_distance_points, 6) AS break_distance_points, sweep_level_id, cisd_id, daily_open_id, range_id, high_anchor_id, low_anchor_id, range_break_id, named.* EXCLUDE (symbol, idx), "
    "k.source_order_block_id AS latest_breaker_order_block_id, latest_unicorn_fvg_id, latest_unicorn_breaker_id, latest_unicorn_order_block_id FROM bars b LEFT JOIN named USING (symbol, idx) LEFT JOIN lastid USING (symbol, idx) LEFT JOIN lastswept USING (symbol, idx) LEFT JOIN lastturn USING (symbol, idx) "
    "LEFT JOIN lastday USING (symbol, idx) LEFT JOIN lastanchor USING (symbol, idx) LEFT JOIN breakers k ON k.breaker_id = latest_breaker_id LEFT JOIN uni_ids USING (latest_unicorn_id))",
)
_GROUPS = {
    "structure": ("break_id", "latest_bos_id", "latest_mss_id", "latest_choch_id", "range_break_id"), "liquidity_level": ("nearest_buy_side_id", "nearest_sell_side_id", "sweep_level_id"), "order_block": ("latest_bullish_order_block_id", "latest_bearish_order_block_id", "latest_breaker_order_block_id", "latest_unicorn_order_block_id"),
    "fvg": ("latest_bullish_fvg_id", "latest_bearish_fvg_id", "nearest_bullish_fvg_id", "nearest_bearish_fvg_id", "latest_unicorn_fvg_id"), "breaker": ("latest_breaker_id", "latest_unicorn_breaker_id"), "cisd": ("cisd_id",), "daily_open": ("daily_open_id",), "dealing_range": ("range_id",), "swing": ("high_anchor_id", "low_anchor_id"),
}

#: The first part of _EVENTS alone: zones with every end they may have.
_EVENTS_DEAD = _EVENTS[: _EVENTS.index("edged AS")].rstrip().rstrip(",")
#: Hours that a market keeps: no weekends, and two hours shut every day.
_WEEK = "isodow(ts) < 6 AND hour(ts) NOT IN (21, 22)"


def week_sql(*ctes: str, select: str) -> str:
    return sql(*ctes, select=select).replace("FROM events GROUP BY ALL", f"FROM events WHERE {_WEEK} GROUP BY ALL")


_COVERAGE_COLUMNS = "SELECT symbol, timestamp, expected, actual, market_closed, undetermined, longest_missing_run, boundary_incomplete, cause, quality, production_eligible FROM covq"
_COVERAGE_SUMMARY = "SELECT symbol, " + ", ".join(f"count(*) FILTER (quality = '{q}')::BIGINT AS quality_{q}" for q in ("complete", "market_gap", "degraded_unknown", "boundary_incomplete")) + ", " + ", ".join(f"count(*) FILTER (cause = '{q}')::BIGINT AS cause_{q}" for q in ("none", "market_closed", "undetermined", "boundary")) + ", count(*) FILTER (NOT production_eligible)::BIGINT AS rejected FROM covq GROUP BY symbol"
_H4_WINDOWS = "SELECT symbol, timestamp, present_hours, missing_hours, closed_hours, disposition, " + ", ".join(f"CASE WHEN disposition = 'emitted' THEN {c} END AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM h4d"
_ZC = "symbol, direction, top, bottom, event_timestamp, confirmation_timestamp"
_LC = "symbol, level_id, liquidity_type, side, price_level, created_timestamp, confirmation_timestamp"

ORACLES = {
    "ticks_to_bars": sql(select="SELECT symbol, timestamp, open, high, low, close, volume FROM bars"),
    "resample_4h": sql(_H4, select="SELECT symbol, timestamp, close_time, open, high, low, close, volume FROM h4"),
    "normalize_bars": sql(_RAW, select="SELECT symbol, timestamp, open, high, low, close, volume FROM flagged WHERE n = 1 AND ok"),
    "normalization_report": sql(
        _RAW,
        select="SELECT symbol, count(*)::BIGINT AS rows_in, count(*) FILTER (n = 1 AND ok)::BIGINT AS rows_out, count(*) FILTER (ts <> timestamp)::BIGINT AS floored, count(*) FILTER (back)::BIGINT AS out_of_order, count(*) FILTER (n > 1)::BIGINT AS duplicates, count(*) FILTER (n = 1 AND NOT ok)::BIGINT AS invalid FROM flagged GROUP BY symbol",
    ),
    "bar_gaps": sql(
        select="""SELECT symbol, before + INTERVAL '1 hour' AS start, timestamp AS "end", (date_diff('hour', before, timestamp) - 1)::BIGINT AS bar_count, date_diff('hour', before, timestamp) - 1 > 3 AS significant
FROM (SELECT *, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS before FROM bars) WHERE timestamp > before + INTERVAL '1 hour'"""
    ),
    "asof_context": sql(_H4, select="SELECT b.symbol, b.timestamp, b.close, h.open AS open_htf, h.high AS high_htf, h.low AS low_htf, h.close AS close_htf, h.timestamp AS timestamp_htf FROM bars b ASOF LEFT JOIN h4 h ON b.symbol = h.symbol AND b.close_time >= h.close_time"),
    "swing_points": sql(_SWINGS, select="SELECT symbol, direction, event_timestamp, confirmation_timestamp, price_level, reference_level FROM swings"),
    "swing_labels": sql(
        _SWINGS,
        select="""SELECT symbol, CASE WHEN direction = 'bullish' THEN CASE WHEN price_level > p THEN 'higher_high' ELSE 'lower_high' END ELSE CASE WHEN price_level > p THEN 'higher_low' ELSE 'lower_low' END END AS label,
  CASE WHEN price_level > p THEN 'bullish' ELSE 'bearish' END AS direction, event_timestamp, greatest(confirmation_timestamp, pc) AS confirmation_timestamp, price_level, p AS reference_level, pe AS previous_swing_timestamp
FROM (SELECT *, lag(price_level) OVER w AS p, lag(confirmation_timestamp) OVER w AS pc, lag(event_timestamp) OVER w AS pe FROM swings WINDOW w AS (PARTITION BY symbol, direction ORDER BY confirmation_timestamp, event_timestamp)) WHERE price_level <> p""",
    ),
    "structure_breaks": sql(_SWINGS, _BREAKS, select="SELECT symbol, event_type, direction, previous_state, event_timestamp, confirmation_timestamp, price_level, reference_level, reference_swing_timestamp FROM breaks"),
    "fvg_zones": sql(_FVG, select=f"SELECT {_ZC}, formation_timestamp, zone_id FROM fvg"),
    "fvg_fills": sql(_FVG, _fills("fvg", "zone_id", "b.idx > z.idx", "fills"), select="SELECT symbol, zone_id, event_timestamp, confirmation_timestamp, round(fill_percentage, 9) AS fill_percentage, deepest_price, status_after FROM fills"),
    "ifvg_zones": sql(_FVG, _IFVG, select="SELECT symbol, CASE direction WHEN 'bullish' THEN 'bearish' ELSE 'bullish' END AS direction, top, bottom, zone_id AS source_fvg_id, hit_close AS confirmation_timestamp, trigger_close, (hit - idx)::BIGINT AS bars_to_invert FROM ifvg"),
    "mitigated_without_inversion": sql(_FVG, _fills("fvg", "zone_id", "b.idx > z.idx", "fills"), _IFVG, select="SELECT symbol, zone_id FROM fills WHERE status_after = 'mitigated' AND zone_id NOT IN (SELECT zone_id FROM ifvg)"),
    "bpr_zones": sql(
        _FVG,
        select="""SELECT u.symbol, CASE WHEN u.confirmation_timestamp >= d.confirmation_timestamp THEN 'bullish' ELSE 'bearish' END AS direction, least(u.top, d.top) AS top, greatest(u.bottom, d.bottom) AS bottom, greatest(u.event_timestamp, d.event_timestamp) AS event_timestamp,
  greatest(u.confirmation_timestamp, d.confirmation_timestamp) AS confirmation_timestamp, u.zone_id AS bullish_fvg_id, d.zone_id AS bearish_fvg_id, abs(date_diff('hour', u.confirmation_timestamp, d.confirmation_timestamp))::BIGINT AS bars_between
FROM fvg u JOIN fvg d ON u.symbol = d.symbol AND u.direction = 'bullish' AND d.direction = 'bearish' AND least(u.top, d.top) > greatest(u.bottom, d.bottom) AND abs(date_diff('hour', u.confirmation_timestamp, d.confirmation_timestamp)) <= 100""",
    ),
    "rdrb_zones": sql(
        select="""SELECT a.symbol, k.direction, CASE k.direction WHEN 'bullish' THEN d.low ELSE b.high END AS top, CASE k.direction WHEN 'bullish' THEN b.low ELSE d.high END AS bottom, a.timestamp AS event_timestamp, d.close_time AS confirmation_timestamp
FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.idx = a.idx + 1 AND b.timestamp = a.close_time JOIN bars c ON c.symbol = a.symbol AND c.idx = a.idx + 2 AND c.timestamp = b.close_time JOIN bars d ON d.symbol = a.symbol AND d.idx = a.idx + 3 AND d.timestamp = c.close_time,
(VALUES ('bullish'), ('bearish')) k(direction)
WHERE CASE k.direction WHEN 'bullish' THEN a.close > a.open AND b.close > b.open AND d.close > d.open AND d.low > b.low ELSE a.close < a.open AND b.close < b.open AND d.close < d.open AND d.high < b.high END"""
    ),
    "order_blocks": sql(_FVG, _RUNS, _OB, select=f"SELECT {_ZC}, order_block_id, break_bar_timestamp, break_close, bars_to_confirm, related_fvg_id, candle_count FROM ob"),
    "order_block_status": sql(
        _FVG, _RUNS, _OB, _FAILED, _fills("ob", "order_block_id", "b.timestamp >= z.confirmation_timestamp", "fills"),
        select="""SELECT ob.symbol, ob.order_block_id, CASE WHEN f.failed_at IS NOT NULL THEN 'invalidated' ELSE coalesce((SELECT arg_max(status_after, idx) FROM fills x WHERE x.zone_id = ob.order_block_id), 'active') END AS status, f.failed_at
FROM ob LEFT JOIN failed f ON f.order_block_id = ob.order_block_id""",
    ),
    "breaker_blocks": sql(_SWINGS, _BREAKS, _FVG, _RUNS, _OB, _FAILED, _BREAKERS, select=f"SELECT {_ZC}, source_order_block_id, break_id, failed_at, failure_close FROM breakers"),
    "unicorns": sql(
        _SWINGS, _BREAKS, _FVG, _RUNS, _OB, _FAILED, _BREAKERS,
        select="""SELECT k.symbol, k.direction, least(k.top, z.top) AS top, greatest(k.bottom, z.bottom) AS bottom, greatest(k.event_timestamp, z.event_timestamp) AS event_timestamp, greatest(k.confirmation_timestamp, z.confirmation_timestamp) AS confirmation_timestamp,
  k.breaker_id AS source_breaker_id, z.zone_id AS source_fvg_id, z.top <= k.top AND z.bottom >= k.bottom AS fully_contained, abs(date_diff('hour', k.confirmation_timestamp, z.confirmation_timestamp))::BIGINT AS bars_between
FROM breakers k JOIN fvg z ON z.symbol = k.symbol AND z.direction = k.direction AND least(k.top, z.top) > greatest(k.bottom, z.bottom) AND abs(date_diff('hour', k.confirmation_timestamp, z.confirmation_timestamp)) <= 50""",
    ),
    "cisd_transitions": sql(_RUNS, _CISD, select="SELECT c.symbol, c.direction, c.previous_state, b.timestamp AS event_timestamp, b.close_time AS confirmation_timestamp, c.first_open AS trigger_level, b.close AS trigger_close, c.first_ts AS leg_start_timestamp, c.n::BIGINT AS leg_length FROM cisd c JOIN bars b ON b.symbol = c.symbol AND b.idx = c.hit"),
    "dealing_ranges": sql(_SWINGS, _BREAKS, _RANGES, select="SELECT symbol, direction, high_price, low_price, equilibrium_price, high_source_id, low_source_id, event_timestamp, confirmation_timestamp, superseded_at FROM ranges"),
    "range_rejections": sql(
        _SWINGS, _BREAKS, _RANGES,
        select="""SELECT symbol, count(*) FILTER (high_price > low_price)::BIGINT - any_value(u.unchanged)::BIGINT AS range, count(*) FILTER (o_id IS NULL)::BIGINT AS missing, count(*) FILTER (high_price <= low_price)::BIGINT AS inverted, any_value(u.unchanged)::BIGINT AS unchanged
FROM priced JOIN (SELECT symbol, count(*) FILTER (ph = high_source_id AND pl = low_source_id) AS unchanged FROM valid GROUP BY symbol) u USING (symbol) GROUP BY symbol""",
    ),
    "range_observations": sql(
        _SWINGS, _BREAKS, _RANGES,
        select="""SELECT b.symbol, b.timestamp AS observation_timestamp, r.range_id, b.close AS price, CASE WHEN abs(b.close - r.equilibrium_price) <= 0.5 * 0.01::DOUBLE THEN 'equilibrium' WHEN b.close > r.equilibrium_price THEN 'premium' ELSE 'discount' END AS zone,
  round((b.close - r.low_price) / (r.high_price - r.low_price), 9) AS percentage_position
FROM bars b JOIN ranges r ON r.symbol = b.symbol AND b.close_time >= r.confirmation_timestamp AND (r.superseded_at IS NULL OR b.close_time < r.superseded_at)""",
    ),
    "session_occurrences": sql(_SESSIONS, select="SELECT * FROM done"),
    "period_levels": sql(_PERIODS, select=f"SELECT {_LC} FROM periods"),
    "daily_opens": sql(select="""SELECT symbol, timezone('America/New_York', timezone('UTC', timestamp))::DATE AS trading_date, open AS price_level, timestamp AS event_timestamp, 'tdo:' || symbol || ':1h:' || timezone('America/New_York', timezone('UTC', timestamp))::DATE::VARCHAR AS level_id
FROM bars WHERE timezone('America/New_York', timezone('UTC', timestamp)) = date_trunc('day', timezone('America/New_York', timezone('UTC', timestamp)))"""),
    "equal_levels": sql(_SWINGS, _equal(50.0), select=f"SELECT {_LC} FROM equals"),
    "liquidity_levels": sql(_SWINGS, _LEVELS, select=f"SELECT {_LC} FROM levels"),
    "liquidity_sweeps": sql(_SWINGS, _LEVELS, _SWEEPS, select="SELECT symbol, level_id, side, event_timestamp, confirmation_timestamp, price_level, extreme_price, closed_beyond, NOT closed_beyond AS is_rejection FROM sweeps"),
    "pending_references": sql(_SWINGS, _BREAKS, select="SELECT symbol, direction, event_timestamp, price_level FROM (SELECT * FROM swings QUALIFY row_number() OVER (PARTITION BY symbol, direction ORDER BY confirmation_timestamp DESC, event_timestamp DESC) = 1) s WHERE NOT EXISTS (SELECT 1 FROM breaks k WHERE k.symbol = s.symbol AND k.direction = s.direction AND k.reference_swing_timestamp = s.event_timestamp)"),
    "level_status": sql(
        _SWINGS, _LEVELS, _SWEEPS,
        select="""SELECT l.symbol, l.level_id, CASE WHEN l.confirmation_timestamp > TIMESTAMP '2024-01-16 12:00:00' THEN 'pending' WHEN s.confirmation_timestamp <= TIMESTAMP '2024-01-16 12:00:00' THEN 'swept'
  WHEN (SELECT min(close_time) FROM bars b WHERE b.symbol = l.symbol AND b.close_time >= l.confirmation_timestamp AND (s.event_timestamp IS NULL OR b.timestamp < s.event_timestamp) AND CASE l.side WHEN 'buy_side' THEN b.high >= l.price_level - 50.0 * 0.01::DOUBLE ELSE b.low <= l.price_level + 50.0 * 0.01::DOUBLE END) <= TIMESTAMP '2024-01-16 12:00:00' THEN 'approached' ELSE 'active' END AS status
FROM levels l LEFT JOIN sweeps s ON s.level_id = l.level_id""",
    ),
    "item_lifetimes": sql(*_ALL, select='SELECT i.symbol, kind, id, a.idx AS start, d.idx AS "end" FROM items i JOIN bars a ON a.symbol = i.symbol AND a.idx = (SELECT min(idx) FROM bars x WHERE x.symbol = i.symbol AND x.close_time >= i.confirmation_timestamp) LEFT JOIN bars d ON d.symbol = i.symbol AND d.close_time = i.dead_at WHERE d.idx IS NULL OR a.idx < d.idx'),
    "active_id_counts": sql(*_ALL, select="SELECT symbol, idx, kind, count(*)::BIGINT AS n FROM alive GROUP BY symbol, idx, kind"),
    "state_features": sql(*_ALL, _OPENS, _VECTOR, select="SELECT symbol, close_time AS as_of, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {c}" for c, x in _FEATURE_SQL.items()) + " FROM votes"),
    "state_contexts": sql(*_ALL, _OPENS, *_CONTEXT, select="SELECT * EXCLUDE (idx) FROM ctx"),
    "provenance_ids": sql(
        *_ALL, _OPENS, *_CONTEXT, "now AS (SELECT * FROM ctx WHERE as_of = TIMESTAMP '2024-01-16 12:00:00')",
        select="SELECT DISTINCT symbol, \"group\", id FROM (" + " UNION ALL ".join(f"SELECT symbol, '{g}' AS \"group\", {c} AS id FROM now" for g, cs in _GROUPS.items() for c in cs)
        + " UNION ALL SELECT symbol, CASE kind WHEN 'ob' THEN 'order_block' WHEN 'level' THEN 'liquidity_level' ELSE kind END, id FROM alive WHERE close_time = TIMESTAMP '2024-01-16 12:00:00'"
        + " UNION ALL SELECT symbol, 'liquidity_level', level_id FROM sweeps WHERE confirmation_timestamp <= TIMESTAMP '2024-01-16 12:00:00' AND symbol IN (SELECT symbol FROM now)) WHERE id IS NOT NULL",
    ),
    "provenance_faults": sql(select="SELECT symbol AS id FROM bars WHERE false"),
    "targets": sql(_target_sql(), select="SELECT symbol, as_of, spec_name, resolved, unresolved_reason, future_return, future_move_points, direction, up_excursion_points, down_excursion_points, outcome, resolving_bar_timestamp, future_window_end FROM tv"),
    "split_labels": sql(_target_sql(), _SPLITS, select="SELECT * FROM labelled"),
    "split_summary": sql(_target_sql(), _SPLITS, select='SELECT symbol, label, count(*)::BIGINT AS n, min(as_of) AS "first", max(as_of) AS "last" FROM labelled GROUP BY symbol, label'),
    "dataset_audit": sql(_target_sql(), _SPLITS, select="""SELECT symbol, count(*)::BIGINT AS n_rows, 0::BIGINT AS duplicates, true AS chronological, min(as_of) AS "first", max(as_of) AS "last", count(*) FILTER (label = 'train')::BIGINT AS train, count(*) FILTER (label = 'validation')::BIGINT AS validation, count(*) FILTER (label = 'test')::BIGINT AS test, count(*) FILTER (label = 'embargoed')::BIGINT AS embargoed FROM labelled GROUP BY symbol"""),
    "dataset_rows": sql(
        *_ALL, _OPENS, _VECTOR, _target_sql(), _SPLITS,
        select="SELECT l.symbol, l.as_of, l.label, l.natural_label, 'r2-07.1' AS feature_version, t.spec_name AS target_name, t.target_type AS target_target_type, 4::BIGINT AS target_horizon_bars, "
        + ", ".join(f"t.{c} AS target_{c}" for c in ("resolved", "unresolved_reason", "future_return", "future_move_points", "direction", "up_excursion_points", "down_excursion_points", "outcome", "resolving_bar_timestamp"))
        + ", " + ", ".join(f"v.{c}" for c in _FEATURE_SQL) + " FROM labelled l JOIN tv t ON t.symbol = l.symbol AND t.as_of = l.as_of AND t.spec_name = 'dir_4' JOIN (SELECT symbol, close_time, "
        + ", ".join(f"round(({x})::DOUBLE, 6) AS {c}" for c, x in _FEATURE_SQL.items()) + " FROM votes) v ON v.symbol = l.symbol AND v.close_time = l.as_of",
    ),
    "market_events": sql(*_ALL, _OPENS, _EVENTS, select="SELECT * REPLACE (round(strength, 6) AS strength) FROM events_all"),
    "zone_status_at": sql(*_ALL, _EVENTS_DEAD, select="SELECT symbol, kind, id, CASE WHEN coalesce(failed_at, parent_full_at) <= t THEN 'invalidated' WHEN full_at <= t THEN 'mitigated' ELSE 'active' END AS status FROM dead, (SELECT TIMESTAMP '2024-01-16 12:30:00' AS t) WHERE confirmation_timestamp <= t"),
    "unicorn_lifecycle": sql(
        *_ALL, _EVENTS_DEAD,
        select="""SELECT symbol, id AS unicorn_id, direction, confirmation_timestamp, retested_at, full_at AS mitigated_at, parent_full_at AS invalidated_at, CASE WHEN parent_full_at IS NOT NULL THEN 'invalidated' WHEN full_at IS NOT NULL THEN 'mitigated' WHEN retested_at IS NOT NULL THEN 'partially_filled' ELSE 'active' END AS status
FROM (SELECT d.*, (SELECT min(close_time) FROM bars b WHERE b.symbol = d.symbol AND b.timestamp >= d.confirmation_timestamp AND CASE d.direction WHEN 'bearish' THEN b.high > d.bottom ELSE b.low < d.top END) AS retested_at FROM dead d WHERE kind = 'unicorn')""",
    ),
    "planted_provenance_faults": sql(
        *_ALL,
        select=f"""SELECT 'lost' AS fault, breaker_id || '?' AS id FROM unis WHERE direction = 'bearish'
UNION ALL SELECT 'early', 'unicorn:' || u.symbol || ':1h:' || {_TS('u.confirmation_timestamp')} || ':' || u.breaker_id || '|' || u.zone_id FROM unis u JOIN fvg z ON z.zone_id = u.zone_id WHERE z.confirmation_timestamp > u.confirmation_timestamp - INTERVAL '1 hour'""",
    ),
    "session_profile": sql(_GRID, select="SELECT symbol, weekday::BIGINT AS weekday, minute::BIGINT AS minute, occurrences::BIGINT AS occurrences FROM shut"),
    "coverage_4h": sql(_H4, _GRID, _COVER, select=_COVERAGE_COLUMNS),
    "coverage_summary": sql(_H4, _GRID, _COVER, select=_COVERAGE_SUMMARY),
    "h4_windows": sql(_H4, _GRID, _COVER, select=_H4_WINDOWS),
    "week_profile": week_sql(_GRID, select="SELECT symbol, weekday::BIGINT AS weekday, minute::BIGINT AS minute, occurrences::BIGINT AS occurrences FROM shut"),
    "week_coverage_4h": week_sql(_H4, _GRID, _COVER, select=_COVERAGE_COLUMNS),
    "week_coverage_summary": week_sql(_H4, _GRID, _COVER, select=_COVERAGE_SUMMARY),
    "week_h4_windows": week_sql(_H4, _GRID, _COVER, select=_H4_WINDOWS),
    "h4_counts": sql(_H4, _GRID, _COVER, select="SELECT symbol, " + ", ".join(f"count(*) FILTER (disposition = '{d}')::BIGINT AS {d}" for d in ("emitted", "withheld_boundary", "withheld_market_closed", "withheld_undetermined")) + ", count(*)::BIGINT AS windows FROM h4d GROUP BY symbol"),
    "tick_report": sql(_QUOTES, select="SELECT symbol, count(*)::BIGINT AS total, count(*) FILTER (missing)::BIGINT AS missing, count(*) FILTER (nonpositive)::BIGINT AS nonpositive, count(*) FILTER (crossed)::BIGINT AS crossed, count(*) FILTER (negative_volume)::BIGINT AS negative_volume, count(*) FILTER (ok AND n > 1)::BIGINT AS duplicates, count(*) FILTER (ok AND n = 1)::BIGINT AS kept, max(ask - bid) FILTER (ok) AS max_spread FROM qn GROUP BY symbol"),
    "clean_quotes": sql(_QUOTES, select="SELECT symbol, timestamp, bid, ask, seq FROM qn WHERE ok AND n = 1"),
    "latest_closed_bars": sql(select="SELECT symbol, max(timestamp) AS timestamp, max(close_time) AS close_time, arg_max(close, timestamp) AS close FROM bars WHERE close_time <= TIMESTAMP '2024-01-16 12:30:00' GROUP BY symbol"),
    "observable_swings": sql(_SWINGS, select="SELECT symbol, direction, event_timestamp, confirmation_timestamp FROM swings WHERE confirmation_timestamp <= TIMESTAMP '2024-01-16 12:30:00'"),
    "session_states": sql(
        _windows(_DEFS, "win"),
        select="""SELECT s.symbol, name, start_utc, high_price, low_price, bar_count, start_utc <= t AND t < end_utc AS is_active, t >= end_utc AS is_complete, round(CASE WHEN high_price <> low_price THEN (c.price - low_price) / (high_price - low_price) END, 9) AS position_in_range
FROM (SELECT symbol, name, start_utc, end_utc, max(high) AS high_price, min(low) AS low_price, count(*)::BIGINT AS bar_count, TIMESTAMP '2024-01-16 12:30:00' AS t FROM bars JOIN win ON timestamp >= start_utc AND close_time <= end_utc AND close_time <= TIMESTAMP '2024-01-16 12:30:00' AND start_utc <= TIMESTAMP '2024-01-16 12:30:00' GROUP BY symbol, name, start_utc, end_utc
  QUALIFY row_number() OVER (PARTITION BY symbol, name ORDER BY start_utc DESC) = 1) s
JOIN (SELECT symbol, arg_max(close, timestamp) AS price FROM bars WHERE close_time <= TIMESTAMP '2024-01-16 12:30:00' GROUP BY symbol) c ON c.symbol = s.symbol""",
    ),
    "pending_periods": sql(_PERIODS, select="SELECT symbol, period, label::DATE AS label, high_price, low_price FROM ext WHERE z < end_utc"),
    "failed_without_structure": sql(_SWINGS, _BREAKS, _FVG, _RUNS, _OB, _FAILED, _BREAKERS, select="SELECT symbol, order_block_id, failed_at FROM failed WHERE order_block_id NOT IN (SELECT source_order_block_id FROM breakers)"),
    "weekday_occurrences": sql(_GRID, select="SELECT symbol, weekday::BIGINT AS weekday, count(DISTINCT timestamp::DATE)::BIGINT AS days FROM g GROUP BY symbol, weekday"),
    "merged_tick_reports": sql(_QUOTES, select="SELECT symbol, count(*)::BIGINT AS total, count(*) FILTER (missing)::BIGINT AS missing, count(*) FILTER (nonpositive)::BIGINT AS nonpositive, count(*) FILTER (crossed)::BIGINT AS crossed, count(*) FILTER (negative_volume)::BIGINT AS negative_volume, max(ask - bid) FILTER (ok) AS max_spread FROM qn GROUP BY symbol"),
    "feature_diagnostics": sql(
        *_ALL, _OPENS, _VECTOR,
        select="SELECT name, count(*) FILTER (v IS NULL)::BIGINT AS missing_count, count(*) FILTER (v IS NULL)::BIGINT AS nan_count, count(v)::BIGINT AS present_count, count(DISTINCT v)::BIGINT AS unique_count, min(v) AS minimum, max(v) AS maximum, round(avg(v), 4) AS mean, count(DISTINCT v) = 1 AS constant FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS name, round(({_FEATURE_SQL[c]})::DOUBLE, 6) AS v FROM votes" for c in _FEATURE_SQL) + ") GROUP BY name",
    ),
    "target_diagnostics": sql(
        _target_sql(),
        select="""SELECT t.spec_name, total, resolved_count, unresolved_count, classes, reasons FROM (SELECT spec_name, count(*)::BIGINT AS total, count(*) FILTER (resolved)::BIGINT AS resolved_count, count(*) FILTER (NOT resolved)::BIGINT AS unresolved_count FROM tv GROUP BY spec_name) t
LEFT JOIN (SELECT spec_name, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS classes FROM (SELECT spec_name, coalesce(direction, outcome) AS k, count(*) AS n FROM tv WHERE coalesce(direction, outcome) IS NOT NULL GROUP BY ALL) GROUP BY spec_name) c ON c.spec_name = t.spec_name
LEFT JOIN (SELECT spec_name, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS reasons FROM (SELECT spec_name, unresolved_reason AS k, count(*) AS n FROM tv WHERE unresolved_reason IS NOT NULL GROUP BY ALL) GROUP BY spec_name) r ON r.spec_name = t.spec_name""",
    ),
}
