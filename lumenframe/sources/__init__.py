"""Reading, writing and cutting tables."""
