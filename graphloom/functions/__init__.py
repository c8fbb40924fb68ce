"""Scalar functions: Cypher's semantics, text measures, and query-text analysis."""
