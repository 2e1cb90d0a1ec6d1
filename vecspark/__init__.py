"""vecspark: vector search and data processing expressed as Spark plans."""

__version__ = "0.1.0"
