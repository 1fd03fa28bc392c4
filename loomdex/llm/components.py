"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import forget, shared_dir, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is one of the nodes.

    Each round, every component joins the neighbour that is first in a pseudo-random order of
    that round, itself included; edges then connect what they were merged into, and those
    within a component go. The random order makes the rounds logarithmic in the size of a
    component, chains and stars included. Round results are written to shared storage, which
    cuts lineage. Nothing is gathered in one task: neighbours are reduced by partial
    aggregation, and joins on a much-linked node can be split.
    """
    spark = edges.sparkSession
    paths = [shared_dir(spark), shared_dir(spark)]
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), paths[0])
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = stored(nodes.withColumn("component", F.col("node")), paths[1])
    turn = 0
    while not links.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        both = links.union(links.select("b", "a"))
        parents = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select("a", F.least("least", rank("a"))["n"].alias("p"))
        new = [shared_dir(spark) for _ in range(3)]
        parents = stored(parents, new[0])
        of = lambda c: parents.select(F.col("a").alias(c), F.col("p").alias(f"p_{c}"))  # noqa: B023, E731
        moved = links.join(of("a"), "a").join(of("b"), "b").where("p_a <> p_b")
        links = stored(moved.select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct(), new[1])
        merged = labels.join(parents, labels["component"] == parents["a"], "left")
        labels = stored(merged.select("node", F.coalesce("p", "component").alias("component")), new[2])
        for p in [*paths, new[0]]:
            forget(spark, p)
        paths = new[1:]
    return labels
