"""Node and edge records to their whole set of triples: types, attributes, nested records, reified
edges, and the ontology terms that any of them touch.

What several branches read goes through ``store(df, name)`` (the command line writes Parquet), so no
record is parsed twice for it. Ontology tables join by Catalyst's own size check; nothing is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.terms import IS_A, curie_to_iri, custom_slot_iri, is_curie
from strandline.operators import flatten, ontology, triples
from strandline.sources.records import category_list

#: Columns of the ontology tables, all strings.
ONTOLOGY = {
    "element": ("term", "kind", "name", "slot_uri", "class_uri", "range"),
    "parent": ("term", "parent"),
    "ancestor": ("term", "ancestor"),
    "enum_value": ("enum", "value"),
    "enum_parent": ("enum", "value", "parent"),
}
NODE_KEYS = ("id", "category")
EDGE_KEYS = ("id", "category", "subject", "predicate", "object")

Store = Callable[[DataFrame, str], DataFrame]


def read_ontology(spark: SparkSession, path: str | None = None) -> dict[str, DataFrame]:
    """The tables as ``path/<name>.parquet``; without a path they are empty, and every term is unknown."""
    if path:
        return {name: spark.read.parquet(f"{path}/{name}.parquet").select(*cols) for name, cols in ONTOLOGY.items()}
    return {name: spark.createDataFrame([], ", ".join(f"{c} string" for c in cols)) for name, cols in ONTOLOGY.items()}


def nested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects inside the attributes of both kinds of record (see ``flatten.nested_nodes``)."""
    of = flatten.nested_nodes(nodes.select(curie_to_iri("id").alias("parent_iri"), "value"), NODE_KEYS)
    return of.unionByName(flatten.nested_nodes(edges.select(curie_to_iri("edge").alias("parent_iri"), "value"), EDGE_KEYS))


def values(nodes: DataFrame, edges: DataFrame, children: DataFrame, onto: dict[str, DataFrame]) -> DataFrame:
    """One row per scalar: s, p, o, and what it touches: ``touched`` (enum, class, predicate or null),
    ``enum`` and ``term``."""
    sources = ((nodes, "id", "value", NODE_KEYS), (edges, "edge", "value", EDGE_KEYS), (children, "child_iri", "child", NODE_KEYS))
    rows = None
    for df, key, text, skip in sources:
        own = flatten.attributes(df.select(curie_to_iri(key).alias("s"), F.col(text).alias("text")), "s", "text", skip)
        rows = own if rows is None else rows.unionByName(own)
    kind = flatten.scalar_kind("value")
    rows = flatten.fan_out(rows, "s").withColumn("kind", kind).where("kind <> 'object'")
    rows = rows.withColumn("term", F.when(F.col("kind") == "string", flatten.scalar_text("value")))
    element = onto["element"].dropDuplicates(["term"])
    slots = element.select(F.col("term").alias("attr"), "slot_uri", F.when(F.col("range").endswith("Enum"), F.col("range")).alias("enum"))
    permitted = onto["enum_value"].select("enum", F.col("value").alias("term"), F.lit(True).alias("permitted")).distinct()
    named = element.where("term like 'biolink:%'").select("term", F.col("class_uri").isNotNull().alias("is_class"), F.col("slot_uri").isNotNull().alias("is_slot"))
    rows = rows.join(slots, "attr", "left").join(permitted, ["enum", "term"], "left").join(named, "term", "left")
    of_enum = F.coalesce("permitted", F.lit(False))
    touched = F.when(of_enum, "enum").when(~is_curie("term"), None).when(F.col("is_class"), "class").when(F.col("is_slot"), "predicate")
    p = F.coalesce(curie_to_iri("slot_uri"), custom_slot_iri("attr"))
    return rows.select("s", p.alias("p"), flatten.render_scalar("value", F.col("enum"), of_enum).alias("o"), touched.alias("touched"), "enum", "term")


def types(nodes: DataFrame, edges: DataFrame, children: DataFrame, ancestor: DataFrame) -> DataFrame:
    """(subject IRI, category) of all records, most specific categories only. Records that share an id count as one."""
    def own(df: DataFrame, key: str, categories: Column | str) -> DataFrame:
        return df.select(curie_to_iri(key).alias("subject"), F.explode(categories).alias("category"))

    of_child = children.select("child_iri", F.expr("try_parse_json(child)").alias("v"))
    rows = own(nodes, "id", "categories").unionByName(own(edges, "edge", "categories")).unionByName(own(of_child, "child_iri", F.expr(category_list("v"))))
    return ontology.most_specific(rows.where("category is not null"), ancestor)


def all_triples(nodes: DataFrame, edges: DataFrame, onto: dict[str, DataFrame], reverse: bool = False, store: Store = lambda df, name: df) -> DataFrame:
    """Distinct (s, p, o, o_kind); subjects and predicates are IRIs, objects of kind ``literal`` rendered text.

    Tables may be empty. Attributes that are null are left out, nulls within lists are the text None."""
    children = store(nested(nodes, edges), "nested")
    scalars = store(values(nodes, edges, children, onto), "values")
    kinds = store(types(nodes, edges, children, onto["ancestor"]), "types")
    slots = ontology.slot_iris(children.select("key").distinct(), onto["element"])
    link = children.join(slots, "key").select(F.col("parent_iri").alias("s"), F.col("slot_iri").alias("p"), F.col("child_iri").alias("o"))
    is_a = F.explode(F.array(F.lit(triples.TYPE), F.lit(IS_A)))
    parts = [triples.reify(edges), scalars.select("s", "p", "o"), link, kinds.select(F.col("subject").alias("s"), is_a.alias("p"), curie_to_iri("category").alias("o"))]
    if reverse:
        parts.append(triples.reverse_aliases(edges))

    # the terms touched: one row each, so the climb through the hierarchies reads no records
    hit = scalars.where("touched is not null").select(F.col("touched").alias("kind"), F.when(F.col("touched") == "enum", F.col("enum")).alias("enum"), "term")
    hit = hit.unionByName(kinds.select(F.lit("class").alias("kind"), F.lit(None).cast("string").alias("enum"), F.col("category").alias("term")))
    hit = hit.unionByName(edges.where("p like 'biolink:%'").select(F.lit("predicate").alias("kind"), F.lit(None).cast("string").alias("enum"), F.col("p").alias("term")))
    hit = store(hit.distinct(), "terms")
    for kind in ("class", "predicate"):
        parts.append(ontology.hierarchy(hit.where(F.col("kind") == kind), onto["element"], onto["parent"], kind))
    parts.append(ontology.enum_hierarchy(hit.where("kind = 'enum'").select("enum", F.col("term").alias("value")), onto["enum_parent"]))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct().withColumn("o_kind", F.when(F.col("o").startswith('"'), "literal").otherwise("iri"))
