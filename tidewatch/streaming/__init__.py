"""Incremental metrics over streams of predictions."""
