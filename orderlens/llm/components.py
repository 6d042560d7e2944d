"""Connected components of a graph given as links."""

from pyspark.sql import functions as F

from orderlens.llm.support import materialize


def components(links):
    """(node, root) for every node of ``links`` (a long, b long); root is the smallest node reached.

    Each round sends every node to its smallest neighbour and on to that node's own choice,
    renames the links and drops those that became loops, until none is left. All steps are
    joins and grouped minima over written tables, so a node with very many links is combined
    before the shuffle or split by the adaptive skew join. Links with a null end are left out.
    No links: an empty result.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = materialize(links.where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty() or labels is None:
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("up")
        )
        step = materialize(step, "step")
        higher = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = step.join(higher, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        if labels is None:
            labels = jump.withColumnRenamed("up", "root")
        else:
            rename = jump.withColumnRenamed("node", "root")
            labels = labels.join(rename, "root", "left").select(
                "node", F.coalesce("up", "root").alias("root")
            )
        labels = materialize(labels, "labels")
        a = jump.select(F.col("node").alias("a"), F.col("up").alias("x"))
        b = jump.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where("x <> y")
        edges = materialize(
            moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges"
        )
    return labels
