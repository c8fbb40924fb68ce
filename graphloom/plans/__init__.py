"""Cypher text to DataFrame plans: lexer, parser, catalog, compiler, and the registered queries."""
