"""Connected components of an edge table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlog.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (columns a, b): the smallest vertex reachable.

    Each round points every vertex at its smallest neighbour, follows the pointers to their roots
    (doubling the distance with each join) and contracts the edges to edges between roots.  Nulls
    and loops are ignored; no edges give no rows."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    found = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("n")).union(e.select("b", "a"))
        to = materialize(both.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("to")), "pointers")
        while True:
            far = to.select(F.col("v").alias("to"), F.col("to").alias("next"))
            jumped = materialize(to.join(far, "to").select("v", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")), "jumped")
            to = jumped.select("v", "to")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = to.select("v", F.col("to").alias("component"))
        else:
            step = to.select(F.col("v").alias("component"), "to")
            found = found.join(step, "component", "left").select("v", F.coalesce("to", "component").alias("component"))
            found = materialize(found, "components")
        ends = [to.select(F.col("v").alias(x), F.col("to").alias(f"{x}2")) for x in ("a", "b")]
        e = e.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2")
        e = materialize(e.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if found is None:
        found = e.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return found
