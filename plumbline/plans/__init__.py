"""Vocabulary and shared plan pieces."""
