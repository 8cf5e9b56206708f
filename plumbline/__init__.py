"""Certainty-graded impact analytics over property graphs, on Spark."""
