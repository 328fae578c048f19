"""Structured Streaming wrappers: the document-wise operators are stateless, so they run on a
streaming DataFrame unchanged."""
