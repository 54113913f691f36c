"""Column statistics and sketches."""
