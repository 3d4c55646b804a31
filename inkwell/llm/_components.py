"""Connected components of edge tables of any size, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import materialize, working_tables


def flattened(parents: DataFrame) -> DataFrame:
    """(node, root) for a forest (node, parent) without cycles, by doubling.

    The side that repeats a root is the outer one of a left join with one row per node, so that runtime
    re-planning can split it however many nodes hang on one root."""
    with working_tables(parents.sparkSession) as work:
        now = materialize(parents.select("node", F.col("parent").alias("root")), "forest")
        while True:
            upper = now.select(F.col("node").alias("root"), F.col("root").alias("_upper"))
            step = now.join(upper, "root", "left").select("node", F.coalesce("_upper", "root").alias("root"), F.col("_upper").isNotNull().alias("_moved"))
            before, now = now, materialize(step, "forest")
            work.drop(before)
            if now.where("_moved").isEmpty():
                work.keep(now)
                return now.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b) of any ordered type: the smallest node of every node's component, for nodes that are not it.

    Nodes hang on to their smallest neighbour, trees are flattened, and edges are drawn anew between roots."""
    with working_tables(edges.sparkSession) as work:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        rest = materialize(both, "edges")
        roots = materialize(rest.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), "roots")
        while not rest.isEmpty():
            tree = flattened(rest.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
            moved = tree.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            kept = roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
            a = tree.select(F.col("node").alias("a"), F.col("root").alias("_a"))
            b = tree.select(F.col("node").alias("b"), F.col("root").alias("_b"))
            drawn = rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b"))
            drawn = drawn.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).where("a <> b").distinct()
            old = roots, rest
            roots, rest = materialize(kept.unionByName(tree), "roots"), materialize(drawn, "edges")
            work.drop(*old)
        return work.keep(roots)
