"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)``; the root is the smallest node it reaches.

    Large-star and small-star turns over the edge table, each written out, until it no longer
    changes. Minima combine before their shuffle; nodes, edges and labels stay in Spark.
    """
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")
    )
    edges = materialize(edges.distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("root"), F.col("node")))
        least = both.groupBy("node").agg(F.least("node", F.min("root")).alias("low"))
        large = (
            both.join(least, "node")
            .where(F.col("root") > F.col("node"))
            .select(F.col("root").alias("node"), F.col("low").alias("root"))
            .distinct()
        )
        large = materialize(large, "large")
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = (
            large.join(low, "node")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("node").alias("node"), F.col("low").alias("root")),
                        F.struct(F.col("root").alias("node"), F.col("low").alias("root")),
                    )
                ).alias("e")
            )
            .select("e.*")
            .where("node <> root")
            .distinct()
        )
        edges = materialize(small, "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select("root").distinct().select(F.col("root").alias("node"), "root")
    return edges.union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))
        ).first()
    )
