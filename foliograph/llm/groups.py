"""Groups of records that pairwise matches link directly or through others.

Low-diameter decomposition: every vertex draws an exponential shift and starts a cluster that much earlier; the
clusters grow along the edges one step at a time and a vertex belongs to whichever reaches it first. Clusters are
contracted to super-vertices, the edges between clusters are kept, and the same is done to the smaller graph until
no edge is left. The assignments of all levels are composed from the top down.

A vertex only ever takes over the cluster of a neighbour, so stopping the growth early leaves more edges for the
next level but never joins what isn't connected. Every step is a join and a minimum that combines before the
shuffle; states are written to the shared folder, so nothing is recomputed if an executor is lost.

Defined cases: rows with a null end are left out; self-links, repeated and turned rows count once; a vertex without
a link to another has no row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.sources.tables import Scratch

#: Rate of the shifts: the larger, the smaller the clusters and the more edges between them.
BETA = 0.2
#: Steps of growth a level may take.
MAX_STEPS = 10


def _start(v, level: int, beta: float):
    """The negated exponential shift of a vertex, drawn from its id and the level."""
    bits = F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 40)).cast("double")
    return F.log((bits + 1.0) / float((1 << 40) + 1)) / beta


def _grow(edges: DataFrame, level: int, beta: float, steps: int, scratch: Scratch) -> DataFrame:
    """(v, center) of every vertex of ``edges`` (src, dst; both directions)."""
    vertices = edges.select(F.col("src").alias("v")).distinct()
    state = scratch.put(vertices.select("v", F.struct(_start(F.col("v"), level, beta).alias("at"), F.col("v").alias("center")).alias("best"), F.lit(True).alias("fresh")))
    for _ in range(steps):
        reached = edges.join(state.filter("fresh"), edges.src == state.v).select(
            F.col("dst").alias("v"), F.struct((F.col("best.at") + 1.0).alias("at"), F.col("best.center").alias("center")).alias("best"), F.lit(None).cast("struct<at:double,center:bigint>").alias("own")
        )
        own = state.select("v", "best", F.col("best").alias("own"))
        after = own.unionByName(reached).groupBy("v").agg(F.min("best").alias("best"), F.max("own").alias("own"))
        grown = scratch.put(after.select("v", "best", (F.col("best") != F.col("own")).alias("fresh")))
        scratch.drop(state)
        state = grown
        if state.filter("fresh").isEmpty():
            break
    return state.select("v", F.col("best.center").alias("center"))


def connected_groups(pairs: DataFrame, left: str = "left_id", right: str = "right_id", beta: float = BETA, max_steps: int = MAX_STEPS) -> DataFrame:
    """(group_id, member_id): every linked id with the smallest id of its group; the smallest has a row too."""
    scratch = Scratch(pairs.sparkSession)
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    once = pairs.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = scratch.put(once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst"))
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        center = scratch.put(_grow(edges, len(levels), beta, max_steps, scratch))
        levels.append(center)
        to = center.select(F.col("v").alias("dst"), F.col("center").alias("dst_center"))
        contracted = (
            edges.join(center, edges.src == center.v)
            .select(F.col("center").alias("src"), "dst")
            .join(to, "dst")
            .select("src", F.col("dst_center").alias("dst"))
            .filter("src != dst")
            .distinct()
        )
        after = scratch.put(contracted)
        scratch.drop(edges)
        edges = after
    if not levels:
        return once.select(F.col("a").alias("group_id"), F.col("b").alias("member_id")).limit(0)
    root = levels[-1].select("v", F.col("center").alias("root"))
    for center in reversed(levels[:-1]):
        up = root.select(F.col("v").alias("center"), "root")
        root = center.join(up, "center", "left").select("v", F.coalesce("root", "center").alias("root"))
    root = scratch.put(root)
    least = root.groupBy("root").agg(F.min("v").alias("group_id"))
    return root.join(least, "root").select("group_id", F.col("v").alias("member_id"))


def expected_steps(n: int, beta: float = BETA) -> float:
    """Steps until the last shift of n vertices has run out, as a guide to max_steps."""
    return math.log(max(n, 2)) / beta
