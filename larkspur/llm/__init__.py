"""Training-data operators: packing, token counting, byte-level BPE, near-duplicate search, quality and toxicity
filters, WARC archives and HTML extraction.

Nothing else in the library imports this subpackage.
"""
