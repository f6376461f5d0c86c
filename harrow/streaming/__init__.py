"""Incremental ingestion as a stream of micro-batches."""
