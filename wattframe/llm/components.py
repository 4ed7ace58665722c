"""Connected components by contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattframe.llm.staging import stage


def _hooked(edges: DataFrame, salt: int) -> DataFrame:
    """(node, up): each end of an edge with the node two steps up.

    A step leads to the neighbour of least hash, if that is less than the node's own; the salt
    makes other hashes in each round.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("hash"), F.col(c).alias("node"))
    least = ends.groupBy("node").agg(F.min(rank("other")).alias("least"))
    steps = stage(least.select("node", F.least("least", rank("node"))["node"].alias("up")), "steps")
    further = steps.select(F.col("node").alias("up"), F.col("up").alias("further"))
    return stage(steps.join(further, "up").select("node", F.col("further").alias("up")), "hooks")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the smallest node reached.

    Each round puts a node's neighbour of least hash in its place and leaves out the loops and
    repeats that makes of edges, so the nodes shrink to less than half on average, whatever the
    shape and order of the graph: rounds grow with the logarithm of a component, and the rows
    of all rounds together with the edges. Both sides of each join are read from files, so
    Spark may split a node with very many edges. Repeated edges and loops change nothing; no
    edges give no rows.
    """
    known = edges.where("a is not null and b is not null")
    rest = stage(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not rest.isEmpty():
        ups = _hooked(rest, len(rounds))
        rounds.append(ups)
        left = ups.select(F.col("node").alias("a"), F.col("up").alias("left"))
        right = ups.select(F.col("node").alias("b"), F.col("up").alias("right"))
        moved = rest.join(left, "a").join(right, "b").where("left != right")
        rest = stage(moved.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct(), "links")
    roots = rounds.pop()
    while rounds:  # where a round led to, the next one may lead on
        on = roots.select(F.col("node").alias("up"), F.col("up").alias("further"))
        roots = stage(
            rounds.pop().join(on, "up", "left").select("node", F.coalesce("further", "up").alias("up")), "roots"
        )
    least = roots.groupBy("up").agg(F.min("node").alias("component"))
    return stage(roots.join(least, "up").select("node", "component"), "labels")
