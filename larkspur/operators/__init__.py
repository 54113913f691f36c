"""Relational operators that Spark composes from several of its own."""
