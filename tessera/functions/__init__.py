"""Functions: predicates, conditionals, scalar functions, optional values and functions by name."""
