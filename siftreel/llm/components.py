"""Distributed connected components by hooking and contraction.

Every round lets each node hook to its smallest neighbour, shortens the resulting chains by pointer jumping, and
replaces the edges by those between the roots. A root that stays has a neighbour that hooked elsewhere or to it, so the
graph shrinks geometrically. Only equi-joins and aggregations with map-side combine are used; nothing is collected but
row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component: the least node reachable.

    Null ends and loops are ignored, repeated edges and both directions count once. No edges: an empty result. Ids may
    be of any ordered type; component has the type of the ids.
    """
    x, y = F.col(a), F.col(b)
    e = table(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(),
        "edges",
    )
    label = None
    while not e.isEmpty():
        hooks = _compressed(table(e.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks"))
        if label is None:
            new = hooks.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        else:
            to = hooks.select(F.col("hi").alias("component"), F.col("lo").alias("_to"))
            new = label.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
            new = new.unionByName(to.join(label.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("_to").alias("component")))
        before, label = label, table(new, "labels")
        up, low = (hooks.select(F.col("hi").alias(k), F.col("lo").alias(f"_{k}")) for k in ("hi", "lo"))
        rest = e.join(up, "hi").join(low, "lo", "left").select(F.col("_hi").alias("p"), F.coalesce("_lo", "lo").alias("q")).where("p != q")
        after = table(rest.select(F.greatest("p", "q").alias("hi"), F.least("p", "q").alias("lo")).distinct(), "edges")
        for x in (e, before, hooks):
            drop(x)
        e = after
    drop(e)
    if label is None:
        return e.sparkSession.createDataFrame([], e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).schema)
    roots = label.select("component").distinct().select(F.col("component").alias("node"), "component")
    return label.unionByName(roots)


def _compressed(hooks: DataFrame) -> DataFrame:
    """Let each hook point to the root of its chain."""
    while True:
        up = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("_up"))
        new = table(hooks.join(up, "lo", "left").select("hi", F.coalesce("_up", "lo").alias("lo"), F.col("_up").isNotNull().alias("moved")), "hooks")
        drop(hooks)
        kept = new.select("hi", "lo")
        kept._siftreel_path = new._siftreel_path
        if new.where("moved").isEmpty():
            return kept
        hooks = kept
