"""Declarative pipelines."""
