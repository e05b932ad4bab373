"""Training-data operators: each module holds one operator, queries.py registers them."""
