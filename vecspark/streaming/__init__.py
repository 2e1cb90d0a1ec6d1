"""Feeding an index from a stream."""

from vecspark.streaming.ingest import insert_stream

__all__ = ["insert_stream"]
