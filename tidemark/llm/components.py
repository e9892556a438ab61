"""Connected components of a graph held in tables, by contraction.

Every round hooks each vertex to the smallest of itself and its neighbours, follows
those pointers, and keeps only the distinct edges between what is left. Pointers go
to smaller vertices, so a component ends at its smallest one. All of it is joins and
map-side combined minima: a vertex of any degree is never gathered. Each round is
written to the shared folder, so the lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def contract(edges: DataFrame, ready: bool = False) -> DataFrame | None:
    """vertex and root (the smallest vertex of its component) for every vertex that has
    an edge to another; None if no vertex has. edges: a, b; ready: they are a stored
    table of distinct rows with a < b."""
    if not ready:
        edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", slim=True)
    roots = None
    while not edges.isEmpty():
        up = _both(edges).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("vertex"), F.least("a", "b").alias("root"))
        far = up.select(F.col("vertex").alias("root"), F.col("root").alias("far"))
        up = up.join(far, "root").select("vertex", F.col("far").alias("root"))
        farther = far.join(far.select(F.col("root").alias("far"), F.col("far").alias("end")), "far").select("root", F.col("end").alias("far"))
        up = stored(up.join(farther, "root").select("vertex", F.col("far").alias("root")), "jumps", slim=True)
        if roots is None:
            roots = up
        else:
            step = up.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
            roots = roots.join(step, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
        a, b = (up.select(F.col("vertex").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        left = edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = stored(left, "edges", slim=True)
    return None if roots is None else stored(roots, "roots", slim=True)


def merge(roots: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
    """Roots after a further contraction of the graph whose vertices are the old roots."""
    if roots is None or more is None:
        return roots if more is None else more
    step = more.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
    old = roots.join(step, "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
    new = more.join(roots.select("vertex"), "vertex", "left_anti")
    return stored(old.unionByName(new), "roots", slim=True)
