"""DataFrame operators: counts, key sets, ranking and request outcomes."""
