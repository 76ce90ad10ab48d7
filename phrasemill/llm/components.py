"""Connected components over a table of links: alternating large and small stars.

Every round is two joins of the links with a partial-aggregated minimum. A node with a great many neighbours (a
hub) is in no shuffle's key: the minima of hubs are few, and are broadcast. Rounds are written to the shared
checkpoint folder, in partitions by their number of links. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.skew import LEAST, hot_join
from phrasemill.session import few, saved


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))


def _star(pairs: DataFrame, keep: Column, hubs: bool) -> DataFrame:
    """For each centre u: link its kept neighbours v to the least of u and its neighbours."""
    least = _least(pairs).withColumn("m", F.least("u", "m"))
    joined = hot_join(pairs, least, ["u"], "many") if hubs else pairs.join(least, "u")
    return joined.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected(links: DataFrame, rounds: int = 60, hub: int = LEAST) -> DataFrame:
    """links: columns u, v of one orderable type. Returns node, root (the least node of its
    component) for every node that has a link to another. Null ends and loops are left out. hub: neighbours
    from which a node counts as one."""
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNotNull() & F.col("v").isNotNull()).alias("ok"))
    edges = saved(ordered.filter("ok AND u <> v").select("u", "v").distinct())
    mark = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = state[0] > hub and bool(both.groupBy("u").count().filter(F.col("count") > hub).limit(1).count())
        large = _star(saved(few(both, 2 * state[0])) if hubs else both, F.col("v") > F.col("u"), hubs).distinct()
        large = saved(few(large, 2 * state[0])) if hubs else large
        least = _least(large)
        near = hot_join(large, least, ["u"], "many") if hubs else large.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = saved(few(small.distinct(), 2 * state[0]))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
