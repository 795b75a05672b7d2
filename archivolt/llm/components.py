"""Connected components by contraction: every round each node joins a neighbour, and the graph shrinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import discard, small_side, written

#: Rounds that take the least neighbour; then the order of nodes is drawn anew in each round.
PLAIN_ROUNDS = 2
#: Joins put into one plan when the rounds' maps are applied one after another.
STEPS_IN_PLAN = 3


def contracted(edges: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(map of each node to the first of itself and its neighbours, in the order of this round; the edges between the images)."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    if step < PLAIN_ROUNDS:
        to = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to"))
    else:
        rank = lambda c: F.xxhash64(F.lit(step), F.col(c))
        first = ends.groupBy("node").agg(F.min_by("other", rank("other")).alias("m"))
        to = first.select("node", F.when(rank("m") < rank("node"), F.col("m")).otherwise(F.col("node")).alias("to"))
    to = written(to, "round")
    for side in ("a", "b"):
        edges = edges.join(to.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to")), side)
    left = edges.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).where("a <> b").distinct()
    return to, written(left, "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): component is the least node reachable.

    Each round maps every node to one of itself and its neighbours by a partial aggregate and replaces the ends of
    edges by their images; repeated edges and loops go. Two rounds take the least neighbour, at which any star falls, and most
    near-duplicate graphs are stars. After them the order is a hash drawn anew in each round, which halves the nodes that
    still have edges on average, however they are numbered: a chain of 1,000 nodes takes about 12 rounds.
    Nothing is collected but whether edges are left. Rounds are written tables, so lost executors cost one round; they are
    deleted in the end. Self-loops and repeated edges are harmless; an empty input gives an empty result; rows with a
    null end are ignored.
    """
    edges = written(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        to, left = contracted(edges, len(maps))
        maps.append(to)
        discard(edges)
        edges = left
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(edges)
    found, held = maps[-1].select("node", F.col("to").alias("component")), []
    for k, step in enumerate(reversed(maps[:-1]), 1):
        later = found.select(F.col("node").alias("to"), F.col("component").alias("c"))
        found = step.join(later, "to", "left").select("node", F.coalesce("c", "to").alias("component"))
        if k % STEPS_IN_PLAN == 0:
            found = written(found, "mapped")
            held.append(found)
    if len(maps) > PLAIN_ROUNDS:  # the images needn't be the least of their components
        found = written(found, "mapped")
        held.append(found)
        least = written(found.groupBy("component").agg(F.min("node").alias("least")), "least")
        held.append(least)
        found = found.join(small_side(least), "component").select("node", F.col("least").alias("component"))
    if len(maps) > 1:
        found = written(found, "components")
        discard(*maps, *held)
    return found
