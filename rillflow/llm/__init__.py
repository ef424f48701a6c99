"""Training-data operators: deduplication, cleaning, scoring, mixing and token output."""
