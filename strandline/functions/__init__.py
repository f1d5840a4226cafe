"""Scalar expressions on RDF terms."""
