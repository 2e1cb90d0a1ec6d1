"""Table sources."""

from vecspark.sources.tables import table, vectors_from_text, write_vectors

__all__ = ["table", "vectors_from_text", "write_vectors"]
