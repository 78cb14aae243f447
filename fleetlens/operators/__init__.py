"""Table-level operators: state, changes, queries, joins and aggregates."""
