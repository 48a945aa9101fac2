"""Connected components of a link table, by repeated contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringwright.llm.store import settle


def _roots(parent: DataFrame) -> DataFrame:
    """Follow ``node -> up`` to the end; pointers go to smaller ids, so each round halves the way."""
    while True:
        upper = parent.select(F.col("node").alias("up"), F.col("up").alias("over"))
        parent = settle(
            parent.join(upper, "up", "left").select(
                "node",
                F.coalesce("over", "up").alias("up"),
                (F.col("over") < F.col("up")).alias("moved"),
            ),
            "roots",
        )
        if not parent.filter("moved").limit(1).count():
            return parent.select("node", "up")
        parent = parent.select("node", "up")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest id reachable.

    Every round each node points to its smallest neighbour, pointers are followed to their end, and
    links between different ends go on. Nothing leaves the cluster; hubs are summed up by partial
    aggregates. Self links make a node known; null ends are left out; no links, no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    found = None
    while True:
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        parent = _roots(settle(parent.select("node", F.least("node", "up").alias("up")), "parents"))
        if found is None:
            found = parent.select("node", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            found = settle(
                found.join(step, "component", "left").select(
                    "node", F.coalesce("up", "component").alias("component")
                ),
                "components",
            )
        ends = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        other = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        links = settle(
            links.join(ends, "a").join(other, "b").where("ra <> rb").select(
                F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")
            ).distinct(),
            "links",
        )
        if not links.limit(1).count():
            return found
