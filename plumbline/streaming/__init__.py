"""Structured Streaming forms of the batch folds."""
