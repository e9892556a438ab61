"""All detectors' results as one table of events, and checks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.swings import stamp
from tidemark.schema import BEAR, BULL, KEY, NEUTRAL, point_of

COLUMNS = (
    *KEY, "detector", "event_type", "direction", "event_timestamp", "confirmation_timestamp", "price_level", "reference_level", "strength", "created_timestamp", "invalidation_timestamp", "status", "source_id", "metadata",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _event(
    df: DataFrame, detector: str, kind: Column, price: str | Column, source: str | Column, direction: str | Column = "direction", reference: str | Column | None = None, strength: str | Column | None = None,
    at: str = "event_timestamp", created: str | None = None, invalidated: str | Column | None = None, status: str | Column = "active", **metadata: str,
) -> DataFrame:
    number = lambda c: F.lit(None).cast("double") if c is None else _col(c).cast("double")
    time = lambda c: F.lit(None).cast("timestamp") if c is None else _col(c)
    meta = F.create_map(*[x for k, c in metadata.items() for x in (F.lit(k), F.col(c).cast("string"))]) if metadata else F.lit(None).cast("map<string,string>")
    values = {
        "detector": F.lit(detector), "event_type": kind, "direction": _col(direction), "event_timestamp": F.col(at), "confirmation_timestamp": F.col("confirmation_timestamp"), "price_level": number(price), "reference_level": number(reference), "strength": number(strength),
        "created_timestamp": time(created), "invalidation_timestamp": time(invalidated), "status": F.lit(status) if isinstance(status, str) else status, "source_id": _col(source), "metadata": meta,
    }
    return df.select(*KEY, *[c.alias(name) for name, c in values.items()])


def _sided(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.col("direction"))


def from_market(m, ends: DataFrame) -> DataFrame:
    """Every event of a market's detectors, with its status at the end of the bars. ends:
    kind, id, filled_at, ended_at of every zone (plans.state.zone_ends).

    Prices are levels or midpoints; the reference is the edge or price that an event is
    measured against; strength is in points, or in price where the event is a zone turned
    around or a range. A swing is an event of its own and one as a liquidity level."""
    point = point_of()
    mid, points = (F.col("top") + F.col("bottom")) / 2, (F.col("top") - F.col("bottom")) / point
    bull = F.col("direction") == BULL
    entry, far = F.when(bull, F.col("top")).otherwise(F.col("bottom")), F.when(bull, F.col("bottom")).otherwise(F.col("top"))
    way = F.when(F.col("side") == "buy_side", BULL).otherwise(BEAR)

    def zones(kind: str, df: DataFrame, id_: str) -> DataFrame:
        own = ends.filter(F.col("kind") == kind).select(F.col("id").alias(id_), "filled_at", "ended_at")
        return df.join(own, id_, "left")

    filled = F.when(F.col("filled_at").isNotNull(), "mitigated").otherwise("active")
    ended = F.when(F.col("ended_at").isNotNull(), "invalidated").otherwise(filled)
    born = {"created": "event_timestamp"}
    levels = m.levels.join(m.sweeps.select("level_id", F.col("idx").alias("_swept")), "level_id", "left")
    s = m.sessions
    four = [("high", "high_price", "high_timestamp", BULL), ("low", "low_price", "low_timestamp", BEAR), ("open", "open_price", "open_timestamp", NEUTRAL), ("close", "close_price", "close_timestamp", NEUTRAL)]
    s = s.withColumn("_e", F.explode(F.array(*[F.struct(F.lit(f"session_{k}").alias("kind"), F.col(p).alias("price"), F.col(at).alias("at"), F.lit(d).alias("way")) for k, p, at, d in four]))).withColumn("event_timestamp", F.col("_e.at"))
    parts = [
        _event(m.swings, "swings", F.when(bull, "swing_high").otherwise("swing_low"), "price_level", "swing_id", reference="reference_level", strength="strength"),
        _event(m.labels, "structure", F.col("label"), "price_level", F.concat_ws(":", F.lit("label"), *KEY, "label", stamp("event_timestamp")), reference="reference_level", strength="strength"),
        _event(m.breaks, "structure", F.col("event_type"), "price_level", "break_id", reference="reference_level", strength="break_distance_points", previous_state="previous_state", swing_id="swing_id"),
        _event(levels, "liquidity", F.col("liquidity_type"), "price_level", "level_id", direction=way, at="created_timestamp", created="created_timestamp", status=F.when(F.col("_swept").isNotNull(), "swept").otherwise("active")),
        _event(m.sweeps, "liquidity", F.lit("liquidity_sweep"), "extreme_price", "level_id", direction=way, reference="price_level", strength="penetration_points", status="swept", liquidity_type="liquidity_type", closed_beyond="closed_beyond"),
        _event(zones("fvg", m.fvg, "zone_id"), "fvg", _sided("fvg"), mid, "zone_id", reference=entry, strength=points, at="formation_timestamp", created="formation_timestamp", invalidated="filled_at", status=filled),
        _event(zones("ifvg", m.ifvg, "ifvg_id"), "ifvg", _sided("ifvg"), mid, "ifvg_id", reference="trigger_close", strength=F.col("top") - F.col("bottom"), status=filled, **born, source_fvg_id="source_fvg_id"),
        _event(zones("ob", m.blocks, "order_block_id"), "order_blocks", _sided("order_block"), mid, "order_block_id", reference=entry, strength="displacement_ratio", invalidated="ended_at", status=ended, **born, related_fvg_id="related_fvg_id"),
        _event(zones("breaker", m.breakers, "breaker_id"), "breakers", _sided("breaker"), mid, "breaker_id", reference=far, status=filled, **born, source_order_block_id="source_order_block_id", source_break_id="break_id"),
        _event(zones("bpr", m.bpr, "bpr_id"), "bpr", F.lit("balanced_price_range"), mid, "bpr_id", reference="top", strength=points, status=filled, **born, bullish_fvg_id="bullish_fvg_id", bearish_fvg_id="bearish_fvg_id"),
        _event(zones("rdrb", m.rdrb, "rdrb_id"), "rdrb", _sided("rdrb"), mid, "rdrb_id", reference=far, strength=points, status=filled, **born),
        _event(m.cisd, "cisd", _sided("cisd"), "trigger_level", "cisd_id", reference="trigger_close", **born, previous_state="previous_state", leg_length="leg_length"),
        _event(zones("unicorn", m.unicorns, "unicorn_id"), "unicorns", _sided("unicorn"), mid, "unicorn_id", reference="top", strength=points, status=ended, **born, source_breaker_id="source_breaker_id", source_fvg_id="source_fvg_id", source_order_block_id="source_order_block_id"),
        _event(m.ranges, "ranges", F.lit("dealing_range"), "equilibrium_price", "range_id", reference="high_price", strength=F.col("high_price") - F.col("low_price"), status=F.when(F.col("superseded_at").isNotNull(), "invalidated").otherwise("active"), **born, source_break_id="source_break_id"),
        _event(m.daily_opens, "daily_opens", F.lit("true_daily_open"), "price_level", "level_id", direction=F.lit(NEUTRAL), **born),
        _event(s, "sessions", F.col("_e.kind"), F.col("_e.price"), F.concat_ws(":", F.lit("session"), *KEY, "_e.kind", "name", F.col("local_date").cast("string")), direction=F.col("_e.way"), reference="open_price", strength=(F.col("high_price") - F.col("low_price")) / point, created="start_utc"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*COLUMNS)


def unresolved_provenance(composites: DataFrame, ids: DataFrame, fields: list[str], id_: str = "id") -> DataFrame:
    """Ids in the fields (strings or arrays of them) that name no row of ids."""
    arrays = [F.col(f) if dict(composites.dtypes)[f].startswith("array") else F.array(f) for f in fields]
    used = composites.select(F.explode(F.array_compact(F.flatten(F.array(*arrays)))).alias(id_))
    return used.join(ids.select(id_).distinct(), id_, "left_anti")


def confirmed_before_sources(composites: DataFrame, sources: DataFrame, field: str, id_: str) -> DataFrame:
    """Composites that claim to be known before a source of theirs is."""
    s = sources.select(F.col(id_).alias(field), F.col("confirmation_timestamp").alias("_source"))
    return composites.join(s, field).filter("_source > confirmation_timestamp")
