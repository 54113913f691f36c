"""Full-text search."""
