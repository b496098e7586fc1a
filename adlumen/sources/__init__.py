"""Reading and writing tables, topics and generated data."""
