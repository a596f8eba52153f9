"""Classes of linked documents: connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoscope.plans.lineage import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    return near.join(least, "a").where("b > a").select(
        F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, is tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.unionByName(own).where("a > b").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node is a root or tied to one root alone, so that each component is
    a star around its least id."""
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.lit(1).alias("parent"), F.lit(0).alias("child")),
        F.struct(F.col("b").alias("id"), F.lit(0).alias("parent"), F.lit(1).alias("child"))))
    roles = edges.select(ends.alias("e")).groupBy("e.id").agg(
        F.sum("e.parent").alias("parents"), F.max("e.child").alias("children"))
    return roles.where("parents > 1 OR (parents = 1 AND children = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node on an edge (a, b), a > b: label is the least id of its
    component.  Edges with a null end are none.

    Each round is two aggregates and two equi-joins over the edges, written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    A node's neighbours are aggregated before any shuffle and never gathered.
    """
    state = materialize(edges.select("a", "b").where("a > b").distinct(), "stars")
    while not _stars_only(state):
        large = materialize(_large_star(state), "stars")
        following = materialize(_small_star(large), "stars")
        discard(state, large)
        state = following
    nodes = state.select(F.col("a").alias("id"), F.col("b").alias("label"))
    roots = state.select(F.col("b").alias("id"), F.col("b").alias("label"))
    return nodes.unionByName(roots).distinct()
