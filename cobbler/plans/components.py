"""Connected components of nodes that share groups, as Spark joins.

The input is a membership table, so a group of many nodes costs as many rows and never all its pairs. Each round gives
every node the least node that it meets in any of its groups, follows these links a few steps (pointer doubling),
and contracts: nodes become what they link to, equal memberships merge, and groups with one node left drop out. "Least" is
in a scrambled order, another one in each round, so links are short and a round leaves a fraction of the nodes, along
chains too.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize

#: Doublings of a round: links are followed 2^DOUBLINGS steps.
DOUBLINGS = 2


def _shared(members: DataFrame) -> DataFrame:
    """``members`` (distinct rows of ``node, group``) of groups with two nodes or more."""
    several = members.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    return members.join(several, "group", "left_semi").select("node", "group")


def components(members: DataFrame, how: str = "table") -> DataFrame:
    """``node, component`` of every node in ``members`` (``node, group``, numbers; nulls are ignored): nodes that share a group,
    directly or through others, have the same component, the least node of all. Intermediate tables are materialised by ``how``.
    """
    members = members.select(F.col("node").cast("long").alias("node"), F.col("group").cast("long").alias("group")).dropna().distinct()
    nodes = members.select("node").distinct()
    left = materialize(_shared(members), how)
    if left.isEmpty():
        return nodes.withColumn("component", F.col("node"))
    nodes = nodes.withColumn("at", F.col("node"))
    for round_ in count():
        if left.isEmpty():
            break
        place = F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), "node")
        least = left.groupBy("group").agg(F.min(place).alias("least"))
        link = left.join(least, "group").groupBy("node").agg(F.min("least").alias("least")).select("node", F.col("least.node").alias("to"))
        for _ in range(DOUBLINGS):
            further = link.select(F.col("node").alias("to"), F.col("to").alias("on"))
            link = link.join(further, "to").select("node", F.col("on").alias("to"))
        link = materialize(link, how)
        nodes = (nodes.join(link.withColumnRenamed("node", "at"), "at", "left")
                 .select("node", F.coalesce("to", "at").alias("at")))
        left = materialize(_shared(left.join(link, "node").select(F.col("to").alias("node"), "group").distinct()), how)
    nodes = materialize(nodes, how)
    names = nodes.groupBy("at").agg(F.min("node").alias("component"))
    return nodes.join(names, "at").select("node", "component")
