"""Column functions that queries use on their own."""

from tidemark.operators.calendar import dst_anomaly, to_utc
from tidemark.operators.ranges import zone_of
from tidemark.operators.swings import stamp
from tidemark.schema import floor_to, point_of

__all__ = ["dst_anomaly", "floor_to", "point_of", "stamp", "to_utc", "zone_of"]
