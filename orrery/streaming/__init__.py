"""Incremental ingestion and ledgers on Structured Streaming, with batch twins."""
