"""lakestat.operators."""
