"""Column rules and the table-level jobs that apply them."""
