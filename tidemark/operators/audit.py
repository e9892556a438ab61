"""Diagnostics of features, targets and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import KEY


def feature_diagnostics(rows: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: missing, nan, present, exact distinct, extremes, mean, constant."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("v")) for f in features])).alias("f")
    v = rows.select(one).select("f.*").withColumn("ok", F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v")))
    out = v.groupBy("name").agg(
        F.count_if(F.col("v").isNull()).alias("missing_count"), F.count_if(F.col("v").isNull() | F.isnan("v")).alias("nan_count"), F.count("ok").alias("present_count"), F.countDistinct("ok").alias("unique_count"), F.min("ok").alias("minimum"), F.max("ok").alias("maximum"), F.avg("ok").alias("mean"),
    )
    return out.withColumn("constant", F.col("unique_count") == 1)


def target_diagnostics(values: DataFrame) -> DataFrame:
    """Per target: totals, resolved, reasons and classes as maps."""
    base = values.groupBy("spec_name", "target_type", "horizon_bars").agg(F.count(F.lit(1)).alias("total"), F.count_if("resolved").alias("resolved_count"), F.count_if(~F.col("resolved")).alias("unresolved_count"))
    parts = []
    for c, name in ((F.col("unresolved_reason"), "unresolved_by_reason"), (F.coalesce("direction", "outcome"), "class_counts")):
        n = values.select("spec_name", c.alias("_k")).filter("_k IS NOT NULL").groupBy("spec_name", "_k").agg(F.count(F.lit(1)).alias("_n"))
        parts.append(n.groupBy("spec_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias(name)))
    return base.join(parts[0], "spec_name", "left").join(parts[1], "spec_name", "left")


def dataset_audit(rows: DataFrame, label: str | None = "label", seq: str = "as_of") -> DataFrame:
    """Per series: rows, duplicates, order, extent, rows per split. seq tells the order in
    which rows were supplied; without one, rows are in order of as_of by definition."""
    before = F.lag("as_of").over(Window.partitionBy(*KEY).orderBy(seq))
    splits = [F.count_if(F.col(label) == s).alias(s) for s in ("train", "validation", "test", "embargoed")] if label else []
    return rows.withColumn("_b", before).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.countDistinct("as_of")).alias("duplicates"), (F.count_if(F.col("_b") > F.col("as_of")) == 0).alias("chronological"), F.min("as_of").alias("first"), F.max("as_of").alias("last"), *splits)
