"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.session import materialise


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the bigint edges ``a, b``; the root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends and contracts the edges to those ends, which at least halves the
    nodes that still have edges. Loops and repeated edges do not matter. Every
    round is a written table, and nothing but counts reaches the driver.
    """
    spark = edges.sparkSession
    edges = materialise(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        hooks = _ends(materialise(hooks, "hooks"))
        if found is None:
            found = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            found = materialise(found, "roots")
        edges = edges.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        edges = edges.join(hooks.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = edges.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = materialise(edges, "edges")
    return found if found is not None else spark.createDataFrame([], "node bigint, root bigint")


def _ends(hooks: DataFrame) -> DataFrame:
    """Hooks that all lead to the end of their chain; each step halves the chains."""
    while True:
        step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        further = materialise(hooks.join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
        hooks = further.select("node", "root")
        if further.where("moved").isEmpty():
            return hooks
