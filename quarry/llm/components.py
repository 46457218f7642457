"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for every node of ``links``; links go both ways.

    Every round gives each node the least root among its neighbours and then follows that root's own root, so the
    rounds needed grow with the logarithm of a component's width. Rounds are written to the shared folder. Hubs meet
    partial minima only: sums per task go through the shuffle, never a hub's whole list.
    """
    both = staged(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
        .unionByName(links.select(F.col(b).alias("a"), F.col(a).alias("b")).where("a <> b")).distinct(), "links")
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    while True:
        near = (
            both.join(roots.hint("merge"), both.b == roots.node)
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen")))
        # What a node sees also bounds the node it pointed to, which lets whole trees move at once.
        moved = roots.join(near.hint("merge"), "node").select("node", "root", F.least("root", "seen").alias("least"))
        hooked = moved.groupBy(F.col("root").alias("node")).agg(F.min("least").alias("hook"))
        now = staged(
            moved.join(hooked.hint("merge"), "node", "left")
            .select("node", F.col("root").alias("was"), F.least("least", F.coalesce("hook", "least")).alias("root")), "roots")
        if now.where("was <> root").isEmpty():  # neighbours agree, so roots are their own roots
            return roots
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = staged(
            now.join(up.hint("merge"), "root", "left")
            .select("node", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
