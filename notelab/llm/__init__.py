"""Training-data operators: filters, near-duplicate joins, dedup, archives and mixing on Spark."""
