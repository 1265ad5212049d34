"""Column functions: text normalisation, predicates, dictionaries."""
