"""Connected components of links that come in rounds."""

from pyspark.sql import DataFrame, functions as F

from modelyard.llm.common import few, written


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (k, comp) after the new `links` (x, y: a written table) between nodes of `labels`.

    Links are lifted to the components, which shrink to their smallest member by taking the smallest neighbour and
    jumping to where it points, until nothing moves. Stars and their unions need two or three steps. Steps are written tables:
    Spark knows their size, and does not shuffle for a join with a small one.
    """
    side = lambda end: labels.select(F.col("k").alias(end), F.col("comp").alias(f"c{end}"))
    size = 2 * links.count()
    edges = links.join(side("x"), "x").join(side("y"), "y").where("cx <> cy").select("cx", "cy")
    edges = written(few(edges.union(edges.select("cy", "cx")).distinct(), size), "links")
    if edges.isEmpty():
        return labels
    roots = edges.groupBy(F.col("cx").alias("c")).agg(F.least(F.min("cx"), F.min("cy")).alias("root"))
    roots = written(few(roots, size), "roots")
    while True:
        # The smallest root next to each node, and where that root itself points.
        near = edges.join(roots.select(F.col("c").alias("cy"), "root"), "cy").groupBy(F.col("cx").alias("c")).agg(F.min("root").alias("near"))
        step = roots.join(near, "c").select("c", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("c").alias("next"), F.col("root").alias("far"))
        step = step.join(jump, "next", "left").select("c", "root", F.least("next", "far").alias("next"))
        step = written(few(step, size), "roots")
        roots = step.select("c", F.col("next").alias("root"))
        if step.where("root <> next").isEmpty():
            break
    moved = roots.select(F.col("c").alias("comp"), "root")
    return written(labels.join(moved, "comp", "left").select("k", F.coalesce("root", "comp").alias("comp")), "labels")
