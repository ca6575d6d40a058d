"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize

#: Edges up to which (counted first) one task holds the graph, and rounds need no shuffle; beyond, edges are dealt by their nodes.
ONE_TASK = 200_000


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, one: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.select(F.col("u").alias("_u"), "m"), F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    whole = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return (whole.coalesce(1) if one else whole).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """u, root of every node that an edge touches, except the roots themselves: root is the smallest node of u's component.

    edges: u, v (long). Rounds grow with the logarithm of the longest path; each is written, so no lineage builds up. Minima are combined before they are shuffled, so a hub of any degree is no single task's load but for its skewed join, which AQE splits.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)

    def mark(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    one = before[0] <= ONE_TASK  # rounds add no edges
    while before[0]:
        shorter = materialize(_small(_large(e.coalesce(1) if one else e), one), label)
        discard(e)
        e, after = shorter, mark(shorter)
        if after == before:
            break
        before = after
    out = e.select("u", F.col("v").alias("root"))
    out.written_at = e.__dict__.pop("written_at")
    return out
