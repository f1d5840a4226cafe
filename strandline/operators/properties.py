"""Properties of resources: direct, reified and attribute triples without the reification predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.terms import RDF
from strandline.sources.shared import stored

HIDDEN = [RDF + "subject", RDF + "predicate", RDF + "object"]


def properties(triples: DataFrame, resources: DataFrame) -> DataFrame:
    """(resource, predicate, value) of every listed resource; triples are a set."""
    own = triples.where(~F.col("p").isin(HIDDEN)).select(F.col("s").alias("resource"), F.col("p").alias("predicate"), F.col("o").alias("value")).distinct()
    return own.join(resources.select("resource").distinct(), "resource", "left_semi")


def ordered(props: DataFrame) -> DataFrame:
    """IRIs before literals, as the standard's term order has it."""
    rank = F.when(F.col("value").startswith('"'), 1).otherwise(0)
    return props.orderBy("resource", "predicate", rank, "value")


def chunked(props: DataFrame, most: int = 10_000) -> DataFrame:
    """(resource, chunk, properties): the sorted (predicate, value) list of each resource in chunks of at most ``most``, from
    chunk 0, in order; no task holds more than a chunk, however many properties a resource has.

    Pairs are dealt into ranges and numbered by their place in the range and the ranges' counts of the resource."""
    part = F.spark_partition_id()
    order = ["resource", "predicate", "value"]
    rows = stored(props.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", part).withColumn("__at", F.monotonically_increasing_id()), "properties")
    # a resource begins at one place in each range that it lies in
    held = rows.groupBy("resource", "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("resource").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    base = held.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("resource", "__range", "__first", "__base")
    nth = F.col("__at") - F.col("__first") + F.col("__base")
    numbered = rows.join(base, ["resource", "__range"]).select(*order, F.floor(nth / most).cast("long").alias("chunk"))
    return numbered.groupBy("resource", "chunk").agg(F.array_sort(F.collect_list(F.struct("predicate", "value"))).alias("properties"))


def grouped(props: DataFrame) -> DataFrame:
    """One row a resource: its sorted (predicate, value) list. For resources whose list fits into a row; ``chunked`` has no such bound."""
    return props.groupBy("resource").agg(F.array_sort(F.collect_list(F.struct("predicate", "value"))).alias("properties"))
