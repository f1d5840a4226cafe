"""Triples from edge rows: direct statements, reification, reverse aliases, text lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.terms import RDF, TRAVERSAL_NS, curie_to_iri, iri_escape, raw_ids, resource, reverse_iri

TYPE = RDF + "type"


def _rows(edges: DataFrame, rows: list[tuple[Column, Column, Column]]) -> DataFrame:
    return edges.select(F.explode(F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in rows])).alias("x")).select("x.*")


def named(edges: DataFrame) -> DataFrame:
    """The edge table with IRIs (e, s, p, o): each is built once, whatever number of triples it goes into."""
    return edges.select(curie_to_iri("edge").alias("e"), *(curie_to_iri(c).alias(c) for c in ("s", "p", "o")))


def _about(lit: Callable[[str], Column] = F.lit) -> list[tuple[Column, Column, Column]]:
    e, s, p, o = F.col("e"), F.col("s"), F.col("p"), F.col("o")
    return [
        (e, lit(TYPE), lit(RDF + "Statement")), (e, lit(TYPE), lit(TRAVERSAL_NS + "TraversalEdge")),
        (e, lit(RDF + "subject"), s), (e, lit(RDF + "predicate"), p), (e, lit(RDF + "object"), o),
        (e, lit(TRAVERSAL_NS + "traversal_from"), s), (e, lit(TRAVERSAL_NS + "traversal_to"), o),
    ]


def reify(edges: DataFrame) -> DataFrame:
    """The direct triple and seven about the edge itself; columns s, p, o are IRIs."""
    return _rows(named(edges), [(F.col("s"), F.col("p"), F.col("o")), *_about()])


def reified_set(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """``reify`` without repetitions, for edges with unique ids (``graph.duplicate_ids`` finds others):
    triples about an edge cannot repeat, so only direct ones are compared. ``distinct`` says that no two edges
    have the same subject, predicate and object either, which spares looking for them."""
    if distinct:
        return reify(edges)
    own = named(edges)
    return own.select("s", "p", "o").distinct().unionByName(_rows(own, _about()))


#: So many listed ids go into the scan's filter; more are joined.
LISTED = 1000


def of_resources(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """The triples of ``reify`` whose subject is a listed resource: edges are found by subject or id first, so
    no other edge is reified. The resources are turned back into the ids that edges carry; up to ``LISTED`` of them reach the
    scan as a list, more are joined."""
    ids = resources.select(F.explode(raw_ids("resource")).alias("id")).distinct()
    few = [r[0] for r in ids.limit(LISTED + 1).collect()]
    listed = resources.select("resource").distinct()

    def found(column: str) -> DataFrame:
        near = edges.where(F.col(column).isin(few)) if len(few) <= LISTED else edges.join(ids.select(F.col("id").alias(column)), column, "left_semi")
        return named(near).join(listed, F.col("e" if column == "edge" else column) == F.col("resource"), "left_semi")

    return found("s").select("s", "p", "o").unionByName(_rows(found("edge"), _about()))


def reverse_aliases(edges: DataFrame) -> DataFrame:
    """Five triples a reverse alias, which is named after the raw edge id and is no statement."""
    own = edges.select(curie_to_iri("edge").alias("e"), curie_to_iri("s").alias("s"), curie_to_iri("o").alias("o"), reverse_iri("edge").alias("r"))
    e, s, o, r, lit = F.col("e"), F.col("s"), F.col("o"), F.col("r"), F.lit
    return _rows(own, [
        (r, lit(TYPE), lit(TRAVERSAL_NS + "TraversalEdge")), (r, lit(TYPE), lit(TRAVERSAL_NS + "ReverseTraversalEdge")),
        (r, lit(TRAVERSAL_NS + "traverses"), e), (r, lit(TRAVERSAL_NS + "traversal_from"), o), (r, lit(TRAVERSAL_NS + "traversal_to"), s),
    ])


def lines(triples: DataFrame) -> DataFrame:
    """N-Triples lines of (s, p, o[, o_kind]); objects of kind ``literal`` are rendered already."""
    o = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(resource("o")) if "o_kind" in triples.columns else resource("o")
    return triples.select(F.concat_ws(" ", resource("s"), resource("p"), o, F.lit(".")).alias("value"))


def reified_lines(edges: DataFrame) -> DataFrame:
    """``lines`` of ``reify``: each of an edge's four terms is escaped once, not in each of the eight lines."""
    terms = named(edges).select(*(resource(c).alias(c) for c in ("e", "s", "p", "o")))
    rows = [(F.col("s"), F.col("p"), F.col("o")), *_about(lambda iri: resource(F.lit(iri)))]
    return terms.select(F.explode(F.array(*[F.concat_ws(" ", *row, F.lit(".")) for row in rows])).alias("value"))


def type_assignments(subjects: DataFrame, categories: DataFrame) -> DataFrame:
    """rdf:type and is_a for each (subject, category) pair."""
    from strandline.functions.terms import IS_A

    both = F.explode(F.array(F.lit(TYPE), F.lit(IS_A)))
    return subjects.join(categories, "subject").select(curie_to_iri("subject").alias("s"), both.alias("p"), curie_to_iri("category").alias("o"))


__all__ = ["reify", "reverse_aliases", "lines", "reified_lines", "type_assignments", "iri_escape"]
