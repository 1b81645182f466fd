"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed

#: A node is heavy if it has more than one in so many of all links: at most twice so many are broadcast.
_HEAVY = 512
#: Links for each task of a round. Rounds shrink a graph, and many near-empty tasks would cost more than its links.
_TASK = 1 << 16


def _star(links: DataFrame, large: bool, total: int, tasks: int) -> DataFrame:
    """large: each node hands its larger neighbours to its least neighbour; else its smaller ones and itself.

    Heavy nodes meet their neighbours by a broadcast, so none of them fills a task of its own.
    """
    u, v = F.col("u"), F.col("v")
    if large:
        around = links.select("u", "v").unionByName(links.select(v.alias("u"), u.alias("v"))).coalesce(tasks)
    else:
        around = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select(u.alias("w"), F.least("m", "u").alias("m"), "degree")
    least = checkpointed(least.coalesce(tasks))  # one row a node; keeps the plans of what follows small
    own, most = F.col("u") == F.col("w"), max(1_000, total // _HEAVY)
    if 2 * total <= most or least.where(F.col("degree") > most).isEmpty():
        joined = around.join(least, own)
    else:
        heavy, light = F.broadcast(least.where(F.col("degree") > most)), least.where(F.col("degree") <= most)
        joined = around.join(heavy.select("w"), own, "left_anti").join(light, own).unionByName(around.join(heavy, own))
    out = joined.select(v.alias("u"), F.col("m").alias("v"), u.alias("own"))
    if large:
        out = out.where(F.col("u") > F.col("own")).select("u", "v")
    else:
        out = out.select("u", "v").unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)


def _settled(links: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) of one orderable type. Returns (node, component) of every linked node, the component being its least node.

    Loops and repeated links do no harm; without links the result is empty. Each round is
    checkpointed, so a lost executor costs one round at most.
    """
    u, v = F.col("u"), F.col("v")
    links = checkpointed(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    while total := links.count():
        tasks = 1 + total // _TASK
        links = links.coalesce(tasks)
        if _settled(links):
            break
        for large in (True, False):
            links = checkpointed(_star(links, large, total, tasks))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
