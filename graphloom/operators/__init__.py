"""Graph, pair, matching and search operators on DataFrames."""
