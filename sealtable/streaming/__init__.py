"""Structured Streaming: sealing rows on the fly, and exactly-once appends to a table."""
