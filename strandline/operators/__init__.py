"""Relational operators: graph, paths, properties, triples, nested records, ontology."""
