"""Training-data operators and the queries that apply them."""
