"""Graph, aggregation, comparison and scoring operators over node and edge DataFrames."""
