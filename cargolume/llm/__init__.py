"""Training-data operators: each module holds one operator, catalog.py registers their queries."""
