"""Reading, writing, evolving and generating tables."""
