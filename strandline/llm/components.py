"""Connected components by alternating large-star and small-star steps, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of longs -> (id, component) for every id in a link; a component is named by
    its smallest id. Each step writes its (shrinking) links to the shared folder; hubs are
    pre-aggregated to one minimum before they are joined back. The number of steps grows with the
    logarithm of the longest chain; ``rounds`` steps that do not settle are an error."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = stored(small, "cc")
        discard(edges)
        edges, now = after, mark(after)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().join(roots.select("id"), "id", "left_anti"))
