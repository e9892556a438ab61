"""Chronological splits with an embargo."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import KEY


class SplitError(ValueError):
    """A split that cannot be made."""


@dataclass(frozen=True)
class Split:
    """Bounds: rows before train_end train, before validation_end validate, others test."""

    train_end: datetime
    validation_end: datetime
    embargo_bars: int = 0

    def __post_init__(self) -> None:
        if self.validation_end <= self.train_end:
            raise SplitError("validation must end after training")
        if self.embargo_bars < 0:
            raise SplitError("embargo_bars must not be negative")

    def covering(self, horizon: int) -> Split:
        return replace(self, embargo_bars=max(self.embargo_bars, horizon))


def by_proportion(instants: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Per series the two bounds (train_end, validation_end) at positions of the ordered
    instants (as_of); raises if a series leaves nothing to test."""
    if train <= 0 or validation <= 0 or train + validation >= 1:
        raise SplitError("train and validation must be positive and leave room for a test period")
    w = Window.partitionBy(*KEY)
    rows = instants.select(*KEY, "as_of").withColumn("_i", F.row_number().over(w.orderBy("as_of")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("_a", F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(train)))).withColumn("_b", F.greatest(F.col("_a") + 1, F.floor(F.col("_n") * F.lit(train + validation))))
    rows = rows.withColumn("_b", F.when(F.col("_b") < F.col("_n"), F.col("_b")).otherwise(F.raise_error(F.lit("too few instants for a test period"))))
    return rows.groupBy(*KEY).agg(F.max(F.when(F.col("_i") == F.col("_a"), F.col("as_of"))).alias("train_end"), F.max(F.when(F.col("_i") == F.col("_b"), F.col("as_of"))).alias("validation_end"))


def assign(rows: DataFrame, bounds: DataFrame | Split, embargo_bars: int = 0) -> DataFrame:
    """rows (as_of, window_end) with natural_label and label. A row is embargoed if its
    target's window reaches its split's end; without a window, if the row embargo_bars
    further on does. Test rows never are."""
    if isinstance(bounds, Split):
        embargo_bars = bounds.embargo_bars
        rows = rows.withColumn("train_end", F.lit(bounds.train_end).cast("timestamp")).withColumn("validation_end", F.lit(bounds.validation_end).cast("timestamp"))
    else:
        rows = rows.join(bounds, list(KEY))
    natural = F.when(F.col("as_of") < F.col("train_end"), "train").when(F.col("as_of") < F.col("validation_end"), "validation").otherwise("test")
    rows = rows.withColumn("natural_label", natural).withColumn("_end", F.when(F.col("natural_label") == "train", F.col("train_end")).when(F.col("natural_label") == "validation", F.col("validation_end")))
    later = F.lead("as_of", max(embargo_bars, 1)).over(Window.partitionBy(*KEY).orderBy("as_of"))
    crosses = F.when(F.col("window_end").isNotNull(), F.col("window_end") >= F.col("_end")).otherwise(F.col("_later") >= F.col("_end"))
    rows = rows.withColumn("_later", later)
    label = F.when(F.lit(embargo_bars > 0) & F.coalesce(crosses, F.lit(False)), "embargoed").otherwise(F.col("natural_label"))
    return rows.withColumn("label", label).drop("_end", "_later", "train_end", "validation_end")


def summary(assigned: DataFrame) -> DataFrame:
    """Rows, first and last instants per series and label."""
    return assigned.groupBy(*KEY, "label").agg(F.count(F.lit(1)).alias("n"), F.min("as_of").alias("first"), F.max("as_of").alias("last"))
