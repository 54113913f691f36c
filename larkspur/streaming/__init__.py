"""Structured Streaming over events; an addition beside the relational engine."""
