"""Ancestor tests by intervals: an acyclic hierarchy is labelled once, then a pair is told by comparing numbers.

Each term gets a tree parent (its smallest) and the place where a walk around the tree enters and leaves it: what lies below
it is entered in between. The walk is a linked list of two elements a term, ranked by pointer doubling, so the
rounds grow with the logarithm of the number of terms, however deep the tree is. Other parents are exceptions: whoever is above such
a parent also has the interval of its child. Sibling order comes from a range sort, so a term with most of all children is
dealt over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ontology import closure
from strandline.sources.shared import discard, stored


@dataclass(frozen=True)
class Labels:
    """``tree``: (term, low, high) of every term; ``extra``: (term, low, high) of what a term has below it outside its own
    interval."""

    tree: DataFrame
    extra: DataFrame


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``nth`` (from 0) in the order of text columns, nulls first, by ranges."""
    part = F.spark_partition_id()
    keys = [F.col(c).asc_nulls_first() for c in order]
    held = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", part).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    base = held.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    return held.join(base, "__part").select(*rows.columns, (F.col("__at") + F.col("__base")).alias("nth"))


def label(parents: DataFrame) -> Labels:
    """Labels of all terms of (term, parent) rows; null rows and rows that are their own parent say nothing. A cycle is an error."""
    edges = stored(parents.select("term", "parent").where("term is not null and parent is not null and term <> parent").distinct(), "labels")
    tree = edges.groupBy("term").agg(F.min("parent").alias("up"))
    terms = edges.select(F.explode(F.array("term", "parent")).alias("term")).distinct()
    nodes = stored(numbered(terms.join(tree, "term", "left").select("up", "term"), ["up", "term"]), "labels")
    child = nodes.where("up is not null").groupBy("up").agg(F.min("nth").alias("first")).withColumnRenamed("up", "term")
    above = nodes.select(F.col("term").alias("up"), F.col("nth").alias("over"))
    beside = nodes.select((F.col("nth") - 1).alias("nth"), F.col("up").alias("__up"), F.col("nth").alias("next"))
    full = nodes.join(child, "term", "left").join(above, "up", "left").join(beside, "nth", "left")
    following = F.when(F.col("__up").eqNullSafe(F.col("up")), F.col("next"))
    enter, leave = 2 * F.col("nth"), 2 * F.col("nth") + 1
    # after entering: the first child, else out again; after leaving: the next sibling, else out of the parent
    onto = F.coalesce(2 * following, 2 * F.col("over") + 1)
    steps = F.explode(F.array(F.struct(enter.alias("id"), F.coalesce(2 * F.col("first"), leave).alias("to")), F.struct(leave.alias("id"), onto.alias("to")))).alias("x")
    walk = stored(full.select(steps).select("x.id", "x.to", F.when(F.col("x.to").isNotNull(), 1).otherwise(0).cast("long").alias("left")), "labels")
    size, rounds = walk.count(), 0
    while not walk.where("to is not null").isEmpty():
        rounds += 1
        if 1 << (rounds - 2 if rounds > 1 else 0) > size:
            raise ValueError("the hierarchy has a cycle")
        ahead = walk.select(F.col("id").alias("to"), F.col("to").alias("__to"), F.col("left").alias("__left"))
        longer = walk.join(ahead, "to", "left").select("id", F.col("__to").alias("to"), (F.col("left") + F.coalesce("__left", F.lit(0))).alias("left"))
        longer = stored(longer, "labels")
        discard(walk)
        walk = longer
    place = walk.select((F.floor(F.col("id") / 2)).alias("nth"), F.when(F.col("id") % 2 == 0, size - F.col("left")).alias("in"), F.when(F.col("id") % 2 == 1, size - F.col("left")).alias("out"))
    place = place.groupBy("nth").agg(F.max("in").alias("low"), F.max("out").alias("high"))
    out = stored(nodes.join(place, "nth").select("term", "low", "high"), "labels")
    # a cycle's terms are never entered from a root
    if out.agg(F.count_distinct("low") != F.count("*")).first()[0]:
        raise ValueError("the hierarchy has a cycle")
    other = edges.join(tree.select("term", F.col("up").alias("parent")), ["term", "parent"], "left_anti")
    over = closure(other.select(F.col("parent").alias("origin"), F.col("parent").alias("term")), edges, ["term"], ("origin",))
    below = other.select(F.col("parent").alias("origin"), F.col("term").alias("child")).join(out.select(F.col("term").alias("child"), "low", "high"), "child")
    far = over.join(below, "origin").select("term", "low", "high").distinct()
    own = out.select("term", F.col("low").alias("__low"), F.col("high").alias("__high"))
    extra = stored(far.join(own, "term").where(~((F.col("low") >= F.col("__low")) & (F.col("high") <= F.col("__high")))).select("term", "low", "high"), "labels")
    discard(walk, nodes, edges, over)
    return Labels(out, extra)


def is_ancestor(pairs: DataFrame, labels: Labels) -> DataFrame:
    """``pairs`` (ancestor, term) with ``above``: whether the one is above the other. Terms without a label are above nothing."""
    low, tree = labels.tree.select("term", F.col("low").alias("__at")), labels.tree
    placed = pairs.select("ancestor", "term").distinct().join(low, "term", "left").join(tree.select(F.col("term").alias("ancestor"), "low", "high"), "ancestor", "left")
    inside = (F.col("__at") > F.col("low")) & (F.col("__at") <= F.col("high"))
    others = placed.select("ancestor", "term", "__at").join(labels.extra.select(F.col("term").alias("ancestor"), "low", "high"), "ancestor")
    others = others.where(F.col("__at").between(F.col("low"), F.col("high"))).select("ancestor", "term", F.lit(True).alias("__by")).distinct()
    return placed.join(others, ["ancestor", "term"], "left").select("ancestor", "term", F.coalesce(inside, F.lit(False)).alias("__in"), "__by").select("ancestor", "term", (F.col("__in") | F.coalesce("__by", F.lit(False))).alias("above"))


def most_specific(categories: DataFrame, labels: Labels) -> DataFrame:
    """(subject, category) without those that are above another category of the subject: intervals are nested, so only the
    category that is entered next can lie within. Exceptions are looked up apart."""
    own = categories.select("subject", "category").distinct()
    placed = own.join(labels.tree.withColumnRenamed("term", "category"), "category", "left")
    following = F.lead("low").over(Window.partitionBy("subject").orderBy(F.col("low").asc_nulls_last()))
    kept = placed.withColumn("__next", following).where(~F.coalesce(F.col("__next") <= F.col("high"), F.lit(False)))
    wide = placed.select("subject", "category").join(labels.extra.select(F.col("term").alias("category"), F.col("low").alias("__low"), F.col("high").alias("__high")), "category")
    met = wide.join(placed.select("subject", F.col("category").alias("__other"), "low"), "subject").where(F.col("low").between(F.col("__low"), F.col("__high")) & (F.col("__other") != F.col("category")))
    return kept.select("subject", "category").join(met.select("subject", "category").distinct(), ["subject", "category"], "left_anti")
