"""Graph operators: each takes a PropertyGraph or an edge list and returns a DataFrame."""
