"""Training-data operators: text preparation, deduplication, scans and mixing on Spark."""
