"""A relational analytics engine of DataFrame and SQL primitives."""
