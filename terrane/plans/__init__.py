"""Predicates and the query builder; they compile to one DataFrame plan."""
