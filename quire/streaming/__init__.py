"""Structured Streaming forms of the polling parts of the pipeline."""
