"""lakestat.functions."""
