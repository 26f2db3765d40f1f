"""Bounded streams over files: idempotent ingestion and keyed interval state."""
