"""Edge tables (edge, s, p, o), their oriented adjacency, and star joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of an oriented edge.
EDGE = ("f", "dir", "edge", "pred", "t")


@dataclass(frozen=True)
class Adjacency:
    """Oriented edges and how they are stored: ``hubs`` (f, slots) names the nodes whose edges are split over several
    values of ``slot``; ``distinct`` says that no row repeats; ``buckets`` is how many the rows are stored in."""

    rows: DataFrame
    hubs: DataFrame | None = None
    distinct: bool = False
    buckets: int | None = None

    def onto(self, walks: DataFrame, key: str, hop: DataFrame, f: str, slot: str) -> DataFrame:
        """``walks`` joined to ``hop`` (the edges, renamed) where ``key`` is their first node ``f``. Walks go to each slot of
        a hub, and equal keys meet where the edges are stored."""
        # walks that come dealt over more tasks than there are buckets would have the edges shuffled to them
        dealt = (lambda df, *keys: df.repartition(self.buckets, *keys)) if self.buckets else (lambda df, *keys: df)
        if self.hubs is None:
            return dealt(walks, key).join(hop, F.col(key) == F.col(f))
        where = self.hubs.select(F.col("f").alias("__hub"), "slots")
        spread = walks.join(where, F.col(key) == F.col("__hub"), "left")
        spread = spread.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("__hub", "slots")
        return dealt(spread, key, "__slot").join(hop, (F.col(key) == F.col(f)) & (F.col("__slot") == F.col(slot))).drop("__slot", slot)


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge twice: (f, dir, edge, pred, t). A self-loop gives both rows."""
    step = F.explode(F.array(
        F.struct(F.col("s").alias("f"), F.lit("forward").alias("dir"), F.col("o").alias("t")),
        F.struct(F.col("o").alias("f"), F.lit("reverse").alias("dir"), F.col("s").alias("t")),
    ))
    return edges.select(step.alias("x"), "edge", F.col("p").alias("pred")).select("x.f", "x.dir", "edge", "pred", "x.t")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("s", "o")).alias("id")).distinct()


def star_join(statements: DataFrame) -> DataFrame:
    """Edges from separate (edge, key, value) statements with key subject, predicate or object:
    repeated edge ids combine, as triples under one name do."""
    part = {k: statements.where(F.col("key") == k).select("edge", F.col("value").alias(c)).distinct() for k, c in (("subject", "s"), ("predicate", "p"), ("object", "o"))}
    return part["subject"].join(part["predicate"], "edge").join(part["object"], "edge").select("edge", "s", "p", "o")


def duplicate_ids(edges: DataFrame) -> DataFrame:
    """Edge ids that are not unique: for these, rows of the edge table and star joins differ."""
    return edges.groupBy("edge").agg(F.count("*").alias("n")).where("n > 1")
