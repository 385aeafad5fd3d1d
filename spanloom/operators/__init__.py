"""Relational operators: graph, entities, retrieval, sampling, integrity."""
