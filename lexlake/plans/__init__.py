"""Compositions of operators: the entity pipeline and the registered queries."""
