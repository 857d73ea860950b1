"""Connected components as DataFrame steps on a shrinking graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, scratch


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end; self loops and nulls are gone."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rooted(edges: DataFrame) -> DataFrame:
    """``node, root``: every node hangs on its least smaller neighbour, and pointers are doubled until all lead to a root."""
    up = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
    while True:
        ahead = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = saved(up.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            return up


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of an edge list ``a, b``; a component is named by its least node, which is listed too.

    Each round hangs every node on a smaller neighbour, replaces edges by those between the
    roots and drops what has become a loop, so at most half of the nodes live on and an
    edge is carried only while it joins two parts. Rounds are written to the shared folder
    and removed at the end. Nulls and self loops are ignored; a node of a self loop alone
    isn't listed. An empty list gives no rows.
    """
    with scratch(edges.sparkSession):
        now, levels = saved(_oriented(edges)), []
        while not now.isEmpty():
            up = _rooted(now)
            levels.append(up)
            ends = now
            for end in ("a", "b"):
                ends = ends.join(up.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
            now = saved(_oriented(ends))
        named = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        for up in reversed(levels):  # a level's roots are the nodes of the one above it
            above = named.select(F.col("node").alias("root"), "component")
            named = up.join(above, "root", "left").select("node", F.coalesce("component", "root").alias("component")).unionByName(named)
            named = saved(named)
        heads = named.select(F.col("component").alias("node"), "component").distinct()
        return saved(named.unionByName(heads), keep=True)
