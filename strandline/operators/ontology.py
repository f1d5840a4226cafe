"""Ontology lookups and hierarchy closures over five small input tables:
element(term, kind, name, slot_uri, class_uri, range), parent(term, parent), ancestor(term,
ancestor), enum_value(enum, value), enum_parent(enum, value, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.terms import IS_A, RDF, RDFS, curie_to_iri, custom_slot_iri, enum_value_iri, plain_literal
from strandline.sources.shared import discard, stored


#: Jumps may outnumber the parent rows by this before the climb goes on in single steps.
SPREAD = 4


def closure(start: DataFrame, parents: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """All keys reachable from ``start`` over (keys, parent) rows, itself included; columns to ``carry`` stay with what is reached.

    By path doubling: a round adds what one jump from the known keys reaches, then joins the jumps to themselves, so that they
    are twice as long. After n rounds all keys within 2**n - 1 steps are known; a round that adds none ends the climb, on cycles
    too. Where keys have so many parents that jumps outgrow the parent rows ``SPREAD`` times, single steps go on from what is
    known. Each round is written to the shared folder, and the one before it is deleted. ``rounds`` of the result counts them."""
    scope, last = keys[:-1], keys[-1]
    up = parents.select(*keys, "parent").where("parent is not null").distinct()
    seen, jumps = stored(start.select(*carry, *keys).distinct(), "closure"), stored(up, "closure")
    have, most, rounds = seen.count(), SPREAD * jumps.count(), 0

    def reached(known: DataFrame, by: DataFrame) -> DataFrame:
        return known.join(by, keys).select(*carry, *scope, F.col("parent").alias(last))

    while True:
        rounds += 1
        more = stored(seen.unionByName(reached(seen, jumps)).distinct(), "closure")
        discard(seen)
        seen, before, have = more, have, more.count()
        if have == before:
            break
        onward = jumps.select(*keys, F.col("parent").alias("__by")).join(jumps.select(*scope, F.col(last).alias("__by"), "parent"), [*scope, "__by"])
        longer = stored(onward.select(*keys, "parent").distinct(), "closure")
        discard(jumps)
        jumps = longer
        size = jumps.count()
        if not size:
            break
        if size > most:
            seen, more_rounds = _single_steps(seen, up, keys, carry)
            rounds += more_rounds
            break
    discard(jumps)
    seen.rounds = rounds
    return seen


def _single_steps(seen: DataFrame, up: DataFrame, keys: list[str], carry: tuple[str, ...]) -> tuple[DataFrame, int]:
    """All that is reachable from ``seen``, one step a round, of what is new only."""
    new, parts, rounds = seen, [seen], 0
    while True:
        rounds += 1
        above = new.join(up, keys).select(*carry, *keys[:-1], F.col("parent").alias(keys[-1])).distinct()
        for known in parts:
            above = above.join(known, [*carry, *keys], "left_anti")
        new = stored(above, "closure")
        if new.isEmpty():
            whole = parts[0]
            for x in parts[1:]:
                whole = whole.unionByName(x)
            out = stored(whole, "closure")
            discard(new, *parts)
            return out, rounds
        parts.append(new)
        if len(parts) > 8:  # few tables to compare with
            whole = parts[0]
            for x in parts[1:]:
                whole = whole.unionByName(x)
            merged = stored(whole, "closure")
            discard(*parts[:-1])
            parts = [merged]


def hierarchy(terms: DataFrame, element: DataFrame, parent: DataFrame, kind: str) -> DataFrame:
    """Type, label and parent triples of the touched terms and all above them. Terms the ontology does not know
    keep their type triple alone."""
    above = closure(terms.select("term"), parent.select("term", "parent"), ["term"])
    type_, link = (RDFS + "Class", RDFS + "subClassOf") if kind == "class" else (RDF + "Property", RDFS + "subPropertyOf")
    s = curie_to_iri("term").alias("s")
    types = above.select(s, F.lit(RDF + "type").alias("p"), F.lit(type_).alias("o"))
    labels = above.join(element, "term").select(s, F.lit(RDFS + "label").alias("p"), plain_literal("name").alias("o"))
    links = above.join(parent, "term").select(s, F.lit(link).alias("p"), curie_to_iri("parent").alias("o"))
    return types.unionByName(labels).unionByName(links).distinct()


def enum_hierarchy(values: DataFrame, enum_parent: DataFrame) -> DataFrame:
    """Label and is_a triples of (enum, value) pairs and all above them; several parents allowed."""
    above = closure(values.select("enum", "value"), enum_parent.select("enum", "value", "parent"), ["enum", "value"])
    s = enum_value_iri("enum", "value").alias("s")
    labels = above.select(s, F.lit(RDFS + "label").alias("p"), plain_literal("value").alias("o"))
    links = above.join(enum_parent, ["enum", "value"]).select(s, F.lit(IS_A).alias("p"), enum_value_iri("enum", "parent").alias("o"))
    return labels.unionByName(links).distinct()


def most_specific(categories: DataFrame, ancestor: DataFrame) -> DataFrame:
    """(subject, category) without those that are an ancestor of another category of the subject."""
    own = categories.select("subject", "category").distinct()
    above = own.join(ancestor, own["category"] == ancestor["term"]).where(F.col("category") != F.col("ancestor")).select("subject", F.col("ancestor").alias("category"))
    return own.join(above, ["subject", "category"], "left_anti")


def slot_iris(keys: DataFrame, element: DataFrame) -> DataFrame:
    """(key, slot_iri): the ontology's slot, else a name in the custom namespace."""
    slots = element.where("slot_uri is not null").select(F.col("term").alias("key"), "slot_uri")
    return keys.join(slots, "key", "left").select("key", F.coalesce(curie_to_iri("slot_uri"), custom_slot_iri("key")).alias("slot_iri"))
