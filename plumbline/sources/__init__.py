"""Readers that make fact, node and edge DataFrames."""
